"""Scoring tables of records: validate, score, decide, pick candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.fields import LABEL_THRESHOLD
from stayline.functions.decisions import add_decisions
from stayline.operators.selection import candidate_rules, email_candidates
from stayline.operators.validation import checked, error_rows, outreach_id, summary, valid_rows, with_status

Scorer = Callable[[DataFrame], DataFrame]


def with_label(scored: DataFrame, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """Label 1 from the threshold on, as in the metrics; null without a probability."""
    p = F.col("p_churn")
    return scored.withColumn("predicted_label", F.when(p >= threshold, 1).when(p < threshold, 0))


def model_scorer(model) -> Scorer:
    """Score with a fitted Spark ML model that starts from the raw features."""
    from pyspark.ml.functions import vector_to_array

    def score(df: DataFrame) -> DataFrame:
        probability = vector_to_array(F.col("probability"))[1]
        return model.transform(df).select(*df.columns, probability.alias("p_churn"))

    return score


def coefficient_scorer(weights: Mapping[str, float], intercept: float) -> Scorer:
    """Score with a logistic model given as weights on table columns."""

    def score(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for name, weight in weights.items():
            total = total + F.lit(float(weight)) * F.col(name)
        return df.withColumn("p_churn", 1.0 / (1.0 + F.exp(-total)))

    return score


@dataclass(frozen=True)
class BatchOutput:
    results: DataFrame
    candidates: DataFrame
    errors: DataFrame
    summary: DataFrame


def decide(valid: DataFrame, score: Scorer) -> DataFrame:
    """Score valid rows and add label and decisions. Row by row, so it also runs on a stream."""
    return add_decisions(with_label(score(valid)))


def result_columns(decided: DataFrame, *extra: str) -> DataFrame:
    return decided.select(
        F.col("row_index").alias("index"),
        "id",
        "predicted_label",
        "p_churn",
        "clv",
        "recommended_action",
        "net_gain",
        *extra,
    )


def score_batch(records: DataFrame, score: Scorer, options: Mapping | None = None) -> BatchOutput:
    """The four tables of a batch run. Nothing runs until one of them is used.

    Results keep e-mail and record id, so contacting customers needs no join
    back to the records. Write results and errors when they are used twice.
    """
    options = options or {}
    mode = options.get("mode", "fail_fast")
    rows = checked(records).withColumn("record_id", outreach_id(records))
    carried = ["email"] if "email" in records.columns else []
    results = result_columns(decide(valid_rows(rows, mode), score), "record_id", *carried)
    return BatchOutput(
        results=results,
        candidates=email_candidates(results, candidate_rules(options)),
        errors=error_rows(rows, mode),
        summary=with_status(summary(rows, mode)),
    )


