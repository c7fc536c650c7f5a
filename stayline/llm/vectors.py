"""Vector rows that can be compared, and copies of one vector as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector that is not null, empty or zero and whose components are finite.

    Of rows that share an id the one with the smallest vector stands.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where("vec_id is not null and embedding is not null").where(~bad & ~zero)
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distinct_vectors(rows: DataFrame, ids: int | None = None) -> DataFrame:
    """One row per distinct vector: embedding, its smallest id, how many ids it has and, if asked for, its `ids` smallest ids.

    Counting combines on the map side, and the smallest ids are cut to `ids`
    in every task before they are shuffled, so a vector that a third of all
    rows hold is no hot group.
    """
    if ids is None:
        return rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= ids)
    return first.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
