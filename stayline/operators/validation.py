"""Checks on scoring records: which fields are wrong, which rows can be scored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import BATCH_MODES, NUMERIC_FEATURES, REQUIRED_FIELDS
from stayline.functions.numbers import number_from_text
from stayline.functions.text import python_quoted, strip_or_null
from stayline.session import stored


def check_mode(mode: str) -> str:
    if mode not in BATCH_MODES:
        raise ValueError(f"options.mode must be one of: {', '.join(BATCH_MODES)}")
    return mode


def _is_missing(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def _parsed(name: str) -> str:
    return f"_number_{name}"


def with_numbers(records: DataFrame) -> DataFrame:
    """Add each numeric field as a number, null where it is missing or spells none.

    The numbers come out of a one-row generator. A filter on them then stays
    behind it, and every text is parsed once; pushed below a plain projection
    the filter would parse all of them a second time.
    """
    numbers = [
        number_from_text(F.col(n).cast("string")) if n in records.columns else F.lit(None).cast("double")
        for n in NUMERIC_FEATURES
    ]
    one_row = F.array(F.struct(*[c.alias(_parsed(n)) for n, c in zip(NUMERIC_FEATURES, numbers)]))
    return records.select("*", F.inline(one_row))


def _is_wrong(name: str) -> Column:
    return F.col(_parsed(name)).isNull()


def _problem(field: Column, message: Column) -> Column:
    return F.struct(field.alias("field"), message.alias("message"))


def missing_problems(df: DataFrame) -> Column:
    """One entry per required field that is absent, null or empty."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("field"), _is_missing(df, n).alias("missing")) for n in REQUIRED_FIELDS]
    )
    return F.transform(
        F.filter(cells, lambda c: c["missing"]),
        lambda c: _problem(c["field"], F.concat(F.lit("Missing required field: "), c["field"])),
    )


def numeric_problems(df: DataFrame) -> Column:
    """One entry per numeric field that does not spell a finite number."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("raw"), _is_wrong(n).alias("wrong"))
            for n in NUMERIC_FEATURES
            if n in df.columns
        ]
    )

    def message(cell: Column) -> Column:
        return F.concat(
            F.lit("Field '"), cell["field"], F.lit("' must be a number (got "), python_quoted(cell["raw"]), F.lit(")")
        )

    return F.transform(F.filter(cells, lambda c: c["wrong"]), lambda c: _problem(c["field"], message(c)))


def _how_many(conditions: Sequence[Column]) -> Column:
    return reduce(add, [c.cast("int") for c in conditions])


def record_id(df: DataFrame) -> Column:
    """customer_id, else row_id, else null."""
    names = [n for n in ("customer_id", "row_id") if n in df.columns]
    return F.coalesce(*[F.col(n).cast("string") for n in names]) if names else F.lit(None).cast("string")


def outreach_id(df: DataFrame, position: str = "row_index") -> Column:
    """First non-blank of id, customer_id and row_id, else idx-<position>."""
    names = [n for n in ("id", "customer_id", "row_id") if n in df.columns]
    given = [strip_or_null(F.col(n).cast("string")) for n in names]
    return F.coalesce(*given, F.concat(F.lit("idx-"), F.col(position).cast("string")))


def checked(records: DataFrame) -> DataFrame:
    """Add `id`, the parsed numbers, `n_problems` and `bad`.

    Casts are judged only where nothing is missing. Whether a row is bad needs
    no messages, so rows can be told apart before any text is put together.
    """
    n_missing = _how_many([_is_missing(records, n) for n in REQUIRED_FIELDS])
    n_wrong = _how_many([_is_wrong(n) for n in NUMERIC_FEATURES])
    texts = [_is_missing(records, n) for n in REQUIRED_FIELDS if n not in NUMERIC_FEATURES]
    return with_numbers(records).withColumns(
        {
            "id": record_id(records),
            "bad": reduce(or_, [*texts, *[_is_wrong(n) for n in NUMERIC_FEATURES]]),
            "n_problems": F.when(n_missing > 0, n_missing).otherwise(n_wrong),
        }
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """Position, verdict and number of problems of checked rows, written once.

    Counts, the first bad row and summaries are then read from three narrow
    columns, and no record is parsed a second time for them.
    """
    return stored(rows.select("row_index", "bad", "n_problems"), "verdicts")


def first_bad_row(rows: DataFrame) -> Column:
    """Position of the first bad row of checked rows or verdicts as a scalar subquery, null when all are fine."""
    return rows.filter("bad").agg(F.min("row_index").alias("first_bad")).scalar()


def error_rows(rows: DataFrame, mode: str = "partial", judged: DataFrame | None = None) -> DataFrame:
    """One row per problem of checked rows; fail_fast stops at the first bad row.

    With the verdicts at hand, fail_fast parses that row alone.
    """
    wanted = rows
    if check_mode(mode) == "fail_fast":
        wanted = wanted.filter(F.col("row_index") == first_bad_row(rows if judged is None else judged))
    wanted = wanted.filter("bad")
    missing = wanted.withColumn("missing", missing_problems(rows))
    problems = F.when(F.size("missing") > 0, F.col("missing")).otherwise(numeric_problems(rows))
    # Bad rows have a problem each. The outer form keeps Spark from testing that first,
    # which would put the messages together twice.
    return missing.select("row_index", "id", F.posexplode_outer(problems).alias("error_no", "problem")).select(
        "row_index", "id", "error_no", "problem.field", "problem.message"
    )


def valid_rows(rows: DataFrame, mode: str = "partial", judged: DataFrame | None = None) -> DataFrame:
    """Checked rows without problems, numbers cast; fail_fast gives none when any row is bad."""
    good = rows
    if check_mode(mode) == "fail_fast":
        good = good.filter(first_bad_row(rows if judged is None else judged).isNull())
    good = good.filter(~F.col("bad"))
    kept = [c for c in rows.columns if c not in {"bad", "n_problems", *map(_parsed, NUMERIC_FEATURES)}]
    return good.select(*[F.col(_parsed(c)).alias(c) if c in NUMERIC_FEATURES else F.col(c) for c in kept])


def summary_counts(seen: Column | None = None) -> list[Column]:
    """Aggregates over checked rows: records, those seen that are valid and invalid, and their errors."""
    seen, bad = F.lit(True) if seen is None else seen, F.col("bad")
    return [
        F.count("*").alias("total_records"),
        F.count_if(seen & ~bad).alias("valid_records"),
        F.count_if(seen & bad).alias("invalid_records"),
        F.coalesce(F.sum(F.when(seen, F.col("n_problems"))), F.lit(0)).cast("long").alias("error_count"),
    ]


def summary(rows: DataFrame, mode: str = "partial") -> DataFrame:
    """Counts of total, valid and invalid records and of errors, as one row.

    fail_fast looks no further than the first bad row: rows before it are
    valid, it alone is invalid.
    """
    seen = None
    if check_mode(mode) == "fail_fast":
        stop = first_bad_row(rows)
        seen = stop.isNull() | (F.col("row_index") <= stop)
    return rows.agg(*summary_counts(seen)).withColumn("mode", F.lit(mode))


def summaries(judged: DataFrame, cases: Mapping[str, Column], modes: Sequence[str] = BATCH_MODES) -> DataFrame:
    """The summary of every case (a condition on the verdicts) in every mode, from two scans of the verdicts.

    The first scan finds where each case stops, the second counts for all of them.
    """
    stops = judged.agg(
        F.struct(*[F.min(F.when(kept & F.col("bad"), F.col("row_index"))).alias(f"_{i}") for i, kept in enumerate(cases.values())])
    ).scalar()
    rows = []
    for i, (name, kept) in enumerate(cases.items()):
        for mode in map(check_mode, modes):
            seen = kept
            if mode == "fail_fast":
                stop = stops[f"_{i}"]
                seen = kept & (stop.isNull() | (F.col("row_index") <= stop))
            _, *counted = summary_counts(seen)
            rows.append(
                F.struct(F.lit(name).alias("records"), F.count_if(kept).alias("total_records"), *counted, F.lit(mode).alias("mode"))
            )
    return judged.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def with_status(summaries: DataFrame) -> DataFrame:
    """Add the batch status to summary rows."""
    has_errors = F.col("error_count") > 0
    return summaries.withColumn(
        "status",
        F.when(has_errors & (F.col("mode") == "fail_fast"), "error")
        .when(has_errors & (F.col("valid_records") == 0), "failed")
        .when(has_errors, "partial")
        .otherwise("success"),
    )
