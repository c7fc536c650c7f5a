"""Whom to contact: usable rows, candidates, recipients, targets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.fields import (
    CANDIDATE_OPTION_KEYS,
    INDEX_INVALID,
    INDEX_OUT_OF_RANGE,
    MAX_EMAILS,
    NO_ACTION,
    NO_ADDRESS,
    REQUEST_THRESHOLD,
)
from stayline.functions.numbers import finite, probability_source, unit_probability, whole_number
from stayline.functions.text import normal_email, strip, strip_or_null
from stayline.operators.ranking import number_rows
from stayline.operators.validation import outreach_id


def usable(results: DataFrame) -> DataFrame:
    """Rows with a finite probability or a non-blank action."""
    return results.filter(
        finite(F.col("p_churn")).isNotNull() | strip_or_null(F.col("recommended_action")).isNotNull()
    )


def with_actions(results: DataFrame, actions: Sequence[str] | None) -> DataFrame:
    """Rows whose action is listed; an empty list does not filter."""
    wanted = [a.strip() for a in actions or [] if a.strip()]
    if not wanted:
        return results
    return results.filter(strip(F.col("recommended_action")).isin(wanted))


@dataclass(frozen=True)
class CandidateRules:
    exclude_no_action: bool = True
    min_p_churn: float | None = None
    min_net_gain: float | None = None
    max_candidates: int | None = None
    allowed_actions: tuple[str, ...] | None = None


def _number_or_none(value, kind):
    try:
        number = kind(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return None if isinstance(number, float) and math.isnan(number) else number


def candidate_rules(options: Mapping) -> CandidateRules:
    """Rules from the first option key that holds an object; unusable values count as unset."""
    given = next((options[k] for k in CANDIDATE_OPTION_KEYS if isinstance(options.get(k), Mapping)), {})
    actions = given.get("allowed_actions")
    return CandidateRules(
        exclude_no_action=bool(given.get("exclude_no_action", True)),
        min_p_churn=_number_or_none(given.get("min_p_churn"), float),
        min_net_gain=_number_or_none(given.get("min_net_gain"), float),
        max_candidates=_number_or_none(given.get("max_candidates"), int),
        allowed_actions=tuple(str(a) for a in actions) if isinstance(actions, list) else None,
    )


def is_candidate(rules: CandidateRules = CandidateRules()) -> Column:
    """Whether a result row is worth an e-mail. An empty list of actions lets nothing pass."""
    p, action, gain = F.col("p_churn"), F.col("recommended_action"), F.col("net_gain")
    keep = finite(p).isNotNull() & action.isNotNull() & finite(gain).isNotNull()
    if rules.exclude_no_action:
        keep &= action != NO_ACTION
    if rules.min_p_churn is not None:
        keep &= p >= rules.min_p_churn
    keep &= gain >= (0.0 if rules.min_net_gain is None else rules.min_net_gain)
    if rules.allowed_actions is not None:
        keep &= action.isin(list(rules.allowed_actions)) if rules.allowed_actions else F.lit(False)
    return F.coalesce(keep, F.lit(False))


def email_candidates(results: DataFrame, rules: CandidateRules = CandidateRules(), position: str = "index") -> DataFrame:
    """Candidates in input order, the first `max_candidates` of them; without a cap nothing is sorted."""
    chosen = results.filter(is_candidate(rules)).select(position, "id", "p_churn", "recommended_action", "net_gain")
    if rules.max_candidates is None or rules.max_candidates < 0:
        return chosen
    return top(chosen, rules.max_candidates, F.col(position)).drop("rank")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows under `order`, with their rank; any n.

    Up to the contract's own cap every task keeps its best n and one window
    ranks those; otherwise rows are ranked by the distributed sort.
    """
    if n > MAX_EMAILS:
        return number_rows(df, *order).filter(F.col("rank") <= n)
    # The window sees n rows at most.
    return df.orderBy(*order).limit(max(n, 0)).withColumn(
        "rank", F.row_number().over(W.orderBy(*order)).cast("long")
    )


def above_threshold(results: DataFrame, threshold: float) -> DataFrame:
    """Rows with a probability in [0, 1] that reaches the threshold."""
    return results.withColumn("p_churn", unit_probability(results, "p_churn")).filter(F.col("p_churn") >= threshold)


def with_contact(results: DataFrame, records: DataFrame | None, threshold: float) -> DataFrame:
    """Rows above the threshold with id and address.

    A missing address or id comes from the source record at the row's position;
    `in_range` tells whether there is one. Results that carry all they need
    (columns email and record_id) are passed without records and not joined.

    Results from elsewhere may bring their own place in the list as `position`:
    the index is then what they say it is, a number or a text, the position
    where there is none, and `has_index` tells whether it is a number at all.
    """
    high = above_threshold(results, threshold)
    if "position" in results.columns:
        said = whole_number(F.col("index"), dict(results.dtypes)["index"])
        index = F.when(F.col("index").isNull(), F.col("position")).otherwise(said)
        high = high.withColumns({"index": index, "has_index": index.isNotNull()})
    else:
        high = high.withColumns({"position": F.col("index"), "has_index": F.lit(True)})
    own = normal_email(F.col("email")) if "email" in results.columns else F.lit(None).cast("string")
    given = strip_or_null(F.col("id").cast("string")) if "id" in results.columns else F.lit(None).cast("string")
    if records is None:
        fallback = F.col("record_id") if "record_id" in results.columns else outreach_id(results, "index")
        return high.select(
            "index", F.coalesce(given, fallback).alias("id"), own.alias("email"), "p_churn", F.col("has_index").alias("in_range"), "position", "has_index"
        )
    address = normal_email(F.col("email")) if "email" in records.columns else F.lit(None).cast("string")
    source = records.select(
        F.col("row_index").alias("index"), address.alias("record_email"), outreach_id(records).alias("record_id")
    )
    return high.drop("record_id").join(source, "index", "left").select(
        "index",
        F.coalesce(given, F.col("record_id")).alias("id"),
        F.coalesce(own, F.col("record_email")).alias("email"),
        "p_churn",
        F.col("record_id").isNotNull().alias("in_range"),
        "position",
        "has_index",
    )


def recipients(
    results: DataFrame, records: DataFrame | None, threshold: float = REQUEST_THRESHOLD, max_emails: int = MAX_EMAILS
) -> DataFrame:
    """The customers to write to, highest probability first."""
    order = [F.desc("p_churn"), F.col("index"), F.col("id")]
    found = with_contact(results, records, threshold).filter(F.col("in_range") & F.col("email").isNotNull())
    return top(found.drop("in_range", "position", "has_index"), max_emails, *order)


def recipient_errors(results: DataFrame, records: DataFrame | None, threshold: float = REQUEST_THRESHOLD) -> DataFrame:
    """Rows above the threshold that cannot be written to, and why."""
    contacts = with_contact(results, records, threshold)
    return contacts.filter(~F.col("in_range") | F.col("email").isNull()).select(
        F.lit("targeting").alias("stage"),
        # A row without a record is told by its own place in the list.
        F.when(F.col("in_range"), F.col("index")).otherwise(F.col("position")).cast("long").alias("row_index"),
        F.when(F.col("in_range"), F.col("id")).alias("id"),
        F.when(F.col("in_range"), NO_ADDRESS)
        .when(F.col("has_index"), INDEX_OUT_OF_RANGE)
        .otherwise(INDEX_INVALID)
        .alias("message"),
    )


def _target_order() -> list[Column]:
    return [F.desc("p_churn"), F.col("has_id").desc(), F.when(F.col("has_id"), F.col("id")), F.col("index")]


def targets(results: DataFrame, threshold: float, max_n: int, require_email: bool = True) -> DataFrame:
    """The n most likely leavers; ties: rows with an id by id, then the others by position.

    The metadata map keeps what the row brought along and adds index and
    probability, which win over given entries of the same name.
    """
    threshold = float(threshold)
    if math.isnan(threshold):
        raise ValueError("'threshold' must be a number")
    max_n = int(max_n)
    given_id = strip_or_null(F.col("id").cast("string")) if "id" in results.columns else F.lit(None).cast("string")
    own = normal_email(F.col("email")) if "email" in results.columns else F.lit(None).cast("string")
    name = strip_or_null(F.col("name")) if "name" in results.columns else F.lit(None).cast("string")
    rows = results.select(
        "index",
        F.coalesce(given_id, F.concat(F.lit("idx-"), F.col("index").cast("string"))).alias("id"),
        own.alias("email"),
        name.alias("name"),
        probability_source(results).alias("p_churn"),
        given_id.isNotNull().alias("has_id"),
        *([F.col("metadata")] if "metadata" in results.columns else []),
    ).filter(F.col("p_churn") >= threshold)
    if require_email:
        rows = rows.filter(F.col("email").isNotNull())
    chosen = top(rows, max_n, *_target_order())
    return chosen.withColumn("metadata", target_metadata(chosen)).drop("has_id")


def target_metadata(targets_: DataFrame) -> Column:
    """Given metadata with index and p_churn put over it."""
    own = F.create_map(
        F.lit("index"), F.col("index").cast("string"), F.lit("p_churn"), F.col("p_churn").cast("string")
    )
    if "metadata" not in targets_.columns:
        return own
    given = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(given, lambda key, _: ~key.isin("index", "p_churn")), own)


def relisted(selected: DataFrame) -> DataFrame:
    """Selected targets in listing order: real ids by id, then idx- ids by position."""
    stand_in = F.col("id").startswith("idx-")
    order = [stand_in, F.when(~stand_in, F.col("id")), F.col("index"), F.col("id")]
    return number_rows(selected, *order, name="position")
