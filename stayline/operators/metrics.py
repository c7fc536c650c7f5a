"""Exact evaluation of scores, for one score column or many groups at once.

Rows are first counted per distinct score, which partial aggregation keeps
small before the shuffle. Everything else runs on that histogram; rows are
looked at again only where a top-k cut falls inside a group of equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import LABEL_THRESHOLD, LIFT_FRACTIONS
from stayline.functions.numbers import finite
from stayline.operators.ranking import running_totals, same
from stayline.session import stored


def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per score, best score first, with running and total counts.

    Rows without a finite score take no part in any metric.
    """
    counted = (
        df.filter(finite(F.col(score)).isNotNull())
        .select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("label"))
        .groupBy(*by, "score")
        .agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    )
    return running_totals(counted, [F.desc("score")], ["n", "pos"], by)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, null when divided by zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _counts_at(threshold: float) -> dict[str, Column]:
    chosen = F.col("score") >= threshold
    neg = F.col("n") - F.col("pos")
    return {
        "tn": F.sum(F.when(~chosen, neg).otherwise(0)),
        "fp": F.sum(F.when(chosen, neg).otherwise(0)),
        "fn": F.sum(F.when(~chosen, F.col("pos")).otherwise(0)),
        "tp": F.sum(F.when(chosen, F.col("pos")).otherwise(0)),
    }


def confusion(df: DataFrame, label: str, score: str, threshold: float = LABEL_THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one pass over the rows with a finite score."""
    df = df.filter(finite(F.col(score)).isNotNull())
    chosen = F.col(score) >= threshold
    positive = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~positive & ~chosen).alias("tn"),
        F.count_if(~positive & chosen).alias("fp"),
        F.count_if(positive & ~chosen).alias("fn"),
        F.count_if(positive & chosen).alias("tp"),
    )


def threshold_metrics(confused: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1 and balanced accuracy to confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return confused.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(recall, F.lit(0.0)),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            # Mean recall over the classes that occur.
            "balanced_accuracy": F.coalesce((recall + specificity) / 2, recall, specificity),
        }
    )


def ranking_metrics(histogram: DataFrame, by: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null where a class is absent."""
    neg = (F.col("n") - F.col("pos")).cast("double")
    better = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2
    total_pos = F.max("total_pos")
    total_neg = F.max(F.col("total_n") - F.col("total_pos"))
    precision = F.col("cum_pos").cast("double") / F.col("cum_n").cast("double")
    return histogram.groupBy(*by).agg(
        ratio(F.sum(neg * better), total_pos.cast("double") * total_neg.cast("double")).alias("roc_auc"),
        ratio(F.sum(F.col("pos").cast("double") * precision), total_pos).alias("pr_auc"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )


def score_threshold(kind: str) -> float:
    """0.5 for probabilities and labels, 0 for decision scores."""
    if kind not in ("probability", "decision", "label"):
        raise ValueError("score kind must be probability, decision or label")
    return 0.0 if kind == "decision" else LABEL_THRESHOLD


def rows_at_k(k: float | int, total: Column) -> Column:
    """How many rows k means: a share in (0, 1] is rounded up, a count must not exceed the total."""
    if isinstance(k, bool) or not isinstance(k, (int, float)):
        raise ValueError("k must be float (fraction) or int (count).")
    if isinstance(k, float):
        if k <= 0 or k > 1:
            raise ValueError("k as float must be in (0, 1].")
        return F.greatest(F.lit(1).cast("long"), F.ceil(total * F.lit(k)).cast("long"))
    if k <= 0:
        raise ValueError("k as int must be in [1, n_samples].")
    too_many = F.raise_error(F.lit("k as int must be in [1, n_samples].")).cast("long")
    return F.when(total < k, too_many).otherwise(F.lit(k).cast("long"))


def lift_curve(
    df: DataFrame,
    label: str,
    score: str,
    id_column: str,
    k_values: Sequence[float | int] = LIFT_FRACTIONS,
    by: Sequence[str] = (),
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Precision, recall and lift among the k best rows, equal scores ordered by id.

    `kind` tells a share from a count of the same value, such as 1.0 and 1.
    """
    if histogram is None:
        histogram = score_histogram(df, label, score, by)
    total = F.col("total_n")
    # Without positives recall and lift are 0 whatever k is; k is checked for precision.
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.lit(float(k)).alias("k"), F.lit("share" if isinstance(k, float) else "count").alias("kind"), rows_at_k(k, total).alias("size"))
            for i, k in enumerate(k_values)
        ]
    )
    first = F.col("cum_n") - F.col("n")
    cuts = histogram.withColumn(
        "cut", F.explode(F.filter(wanted, lambda w: (w["size"] > first) & (w["size"] <= F.col("cum_n"))))
    ).select(
        *by,
        "score",
        F.col("cut.no").alias("no"),
        F.col("cut.k").alias("k"),
        F.col("cut.kind").alias("kind"),
        F.col("cut.size").alias("size"),
        (F.col("cut.size") - first).alias("need"),
        "n",
        "pos",
        (F.col("cum_pos") - F.col("pos")).alias("pos_before"),
        "total_n",
        "total_pos",
    )
    # One row per k and group. A cut through equal scores of both labels is open.
    is_open = (F.col("need") < F.col("n")) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    inside = F.when(F.col("need") == F.col("n"), F.col("pos")).when(F.col("pos") == F.col("n"), F.col("need")).otherwise(0)
    # Written, so that Spark knows the size of both sides of the joins below.
    cuts = stored(cuts, "cuts")
    open_cuts = cuts.filter(is_open)
    if not open_cuts.isEmpty():
        ranked = _ranked_hits(df, label, score, id_column, by, stored(open_cuts, "open_cuts"))
        ranked, equal = same(cuts, ranked, [*by, "no"])
        cuts = cuts.join(ranked, equal, "left")
        inside = F.coalesce(F.col("ranked_hits"), inside)
    found = cuts.withColumn("hits", F.col("pos_before") + inside)
    precision = ratio(F.col("hits"), F.col("size"))
    prevalence = ratio(F.col("total_pos"), F.col("total_n"))
    return found.select(
        *by,
        "k",
        "kind",
        "size",
        precision.alias("precision_at_k"),
        F.coalesce(ratio(F.col("hits"), F.col("total_pos")), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.try_divide(precision, prevalence), F.lit(0.0)).alias("lift_at_k"),
    )


def _ranked_hits(df: DataFrame, label: str, score: str, id_column: str, by: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Positives up to each open cut, from one running sum over the rows of the cut scores in order of id.

    A cut looks up the one row at its place, so however many rows share a score no join meets a hot key.
    """
    key = [*by, "score"]
    rows = df.filter(finite(F.col(score)).isNotNull()).select(
        *by,
        F.col(score).cast("double").alias("score"),
        F.col(label).cast("long").alias("label"),
        F.col(id_column).alias("id"),
    )
    keys, equal = same(rows, cuts.select(*key).distinct(), key)
    tied = rows.join(keys, equal, "left_semi").withColumn("one", F.lit(1).cast("long"))
    placed = running_totals(tied, [*key, "id"], ["one", "label"])
    starts = placed.groupBy(*key).agg(F.min("cum_one").alias("start"), F.min(F.col("cum_label") - F.col("label")).alias("before"))
    wanted = cuts.select(*key, "no", "need")
    starts, equal = same(wanted, starts, key)
    places = wanted.join(starts, equal).select(*by, "no", (F.col("start") + F.col("need") - 1).alias("place"), "before")
    return places.join(placed.select("cum_one", "cum_label"), F.col("place") == F.col("cum_one")).select(
        *by, "no", (F.col("cum_label") - F.col("before")).alias("ranked_hits")
    )


def metrics_report(
    df: DataFrame, label: str, score: str, threshold: float = LABEL_THRESHOLD, by: Sequence[str] = (), histogram: DataFrame | None = None
) -> DataFrame:
    """All threshold and ranking metrics, one row per group, from one histogram."""
    if histogram is None:
        histogram = score_histogram(df, label, score, by)
    return threshold_metrics(ranking_metrics(histogram, by, _counts_at(threshold)))
