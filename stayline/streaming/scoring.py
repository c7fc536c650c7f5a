"""Scoring records as they arrive: the batch steps on a stream, without sorts or limits.

Scoring looks at one row at a time, so no watermark or state is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stayline.operators.scoring import Scorer, decide, result_columns
from stayline.operators.validation import checked, error_rows, summary, summary_counts, valid_rows, with_status


def read_records(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(records: DataFrame, score: Scorer) -> tuple[DataFrame, DataFrame]:
    """Streams of results and of errors."""
    rows = checked(records)
    return result_columns(decide(valid_rows(rows), score)), error_rows(rows)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table until the available input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_summaries(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One summary row per micro-batch; a repeated batch overwrites its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        summary(checked(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@dataclass(frozen=True)
class StreamTables:
    """What a scoring stream has written so far; `batch` is the micro-batch a row came with."""

    results: DataFrame
    errors: DataFrame
    summary: DataFrame


def batch_writer(score: Scorer, folder: str) -> Callable[[DataFrame, int], None]:
    """Write results, errors and counts of one micro-batch, each record checked once.

    Every table has a folder per batch that is overwritten as a whole. A batch
    that comes again, after a failure at any place, leaves the same rows as
    one that came once. Counts are observed while the results are written.
    """

    def store(batch: DataFrame, number: int) -> None:
        def write(table: DataFrame, name: str) -> None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

        rows = checked(batch).persist()
        try:
            seen = Observation()
            write(result_columns(decide(valid_rows(rows.observe(seen, *summary_counts())), score)), "results")
            write(error_rows(rows), "errors")
            counts = batch.sparkSession.createDataFrame([seen.get], SUMMARY)
            write(with_status(counts.withColumn("mode", F.lit("partial"))), "summary")
        finally:
            rows.unpersist()

    return store


SUMMARY = "total_records long, valid_records long, invalid_records long, error_count long"


def write_scored(records: DataFrame, score: Scorer, folder: str, checkpoint: str) -> StreamingQuery:
    """Score a stream into the three tables of a batch run until the available input is used up."""
    return records.writeStream.foreachBatch(batch_writer(score, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scored(spark: SparkSession, folder: str) -> StreamTables:
    return StreamTables(*[spark.read.parquet(f"{folder}/{name}") for name in ("results", "errors", "summary")])
