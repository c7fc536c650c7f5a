"""Send outcomes, error lists and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import SENT_STATUSES


def _is_success(code: Column) -> Column:
    return code.try_cast("int").between(200, 299)


def send_ok(status: Column, ok: Column, code: Column) -> Column:
    """Whether a send worked: by ok, else by status code, else whether there is any answer."""
    return (
        F.when(ok.isNotNull(), ok)
        .when(code.isNotNull(), F.coalesce(_is_success(code), F.lit(False)))
        .otherwise(status.isNotNull())
    )


def send_status(status: Column, ok: Column, code: Column) -> Column:
    """A label for a send: the reported status, else derived from ok or code, else sent."""

    def label(worked: Column) -> Column:
        return F.when(worked, "sent").otherwise("error")

    number = code.try_cast("int")
    return (
        F.when(status.isNotNull(), status)
        .when(ok.isNotNull(), label(ok))
        .when(code.isNotNull() & number.isNull(), code.cast("string"))
        .when(code.isNotNull(), label(_is_success(code)))
        .otherwise("sent")
    )


def with_outcome(log: DataFrame) -> DataFrame:
    columns = F.col("status"), F.col("ok"), F.col("status_code")
    return log.withColumns({"sent_ok": send_ok(*columns), "send_status": send_status(*columns)})


def send_summary(log: DataFrame) -> DataFrame:
    """Attempted, sent and failed messages of a send log."""
    return with_outcome(log).agg(
        F.count("*").alias("attempted"),
        F.count_if("sent_ok").alias("sent"),
        F.count_if(~F.col("sent_ok")).alias("failed"),
    )


def send_errors(log: DataFrame) -> DataFrame:
    return with_outcome(log).filter(~F.col("sent_ok")).select(
        F.lit("send").alias("stage"),
        F.col("id").cast("string").alias("id"),
        F.lit("Email provider reported a failed send attempt").alias("message"),
    )


def errors_by_stage(stages: dict[str, DataFrame]) -> DataFrame:
    """All errors in one table, with the stage they come from; absent columns are null."""
    parts = [df.withColumn("stage", F.lit(stage)) for stage, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def outreach_summary(batch: DataFrame, selected: DataFrame, threshold: float, max_emails: int, dry_run: bool) -> DataFrame:
    """Counts and settings of an outreach run, from a batch summary row and the drafted customers."""
    drafted = selected.agg(F.count("*").alias("n")).scalar()
    return batch.select(
        F.col("total_records").alias("n_records"),
        F.col("valid_records").alias("n_valid"),
        F.col("invalid_records").alias("n_invalid"),
        drafted.alias("n_selected"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(int(max_emails)).alias("max_emails"),
        F.lit(bool(dry_run)).alias("dry_run"),
    )


def outreach_status(n_errors: Column, n_valid: Column) -> Column:
    return F.when(n_errors == 0, "ok").when(n_valid > 0, "partial").otherwise("error")


def run_summary(total_rows: Column, valid: Column, selected: Column, result_status: Column, mode: Column, status: Column) -> list[Column]:
    """Rows, usable predictions, selected, drafted and sent of one run over a batch."""
    drafted = F.when(F.lower(result_status) == "error", 0).otherwise(selected).cast("long")
    went_out = (F.lower(mode) == "send") & F.lower(status).isin(SENT_STATUSES)
    return [
        total_rows.cast("long").alias("total_rows"),
        valid.cast("long").alias("valid_predictions"),
        selected.cast("long").alias("selected"),
        drafted.alias("drafted"),
        F.when(went_out, drafted).otherwise(0).cast("long").alias("sent"),
    ]


def run_status(n_errors: Column, selected: Column) -> Column:
    """ok without errors; with errors of the batch or any stage, partial if someone was selected."""
    return F.when(n_errors == 0, "ok").when(selected > 0, "partial").otherwise("error")
