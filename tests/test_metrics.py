import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import metrics
from stayline.operators.ranking import number_rows, running_totals


def scores(spark, labels, values, group=None):
    rows = [(i, int(y), float(s), group[i] if group else "a") for i, (y, s) in enumerate(zip(labels, values))]
    return spark.createDataFrame(rows, "id long, y int, s double, g string")


def brute_auc(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    return ((pos > neg).sum() + 0.5 * (pos == neg).sum()) / (pos.size * neg.size)


def brute_ap(y, s):
    y, s = np.array(y), np.array(s)
    total, recall = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        chosen = y[s >= cut]
        now = chosen.sum() / y.sum()
        total += (now - recall) * chosen.mean()
        recall = now
    return total


def brute_at_k(y, s, size):
    order = np.lexsort((np.arange(len(y)), -np.array(s)))
    return np.array(y)[order][:size].sum()


@pytest.mark.parametrize(
    "y, s, auc, ap",
    [
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, 0.833333),
        ([0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.4, 0.9], 0.5, 0.533333),
    ],
)
def test_golden_ranking(spark, y, s, auc, ap):
    row = metrics.metrics_report(scores(spark, y, s), "y", "s").first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-6)
    assert row["pr_auc"] == pytest.approx(ap, abs=1e-6)


def test_golden_threshold(spark):
    row = metrics.metrics_report(scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), "y", "s").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 1, 1)
    assert row["accuracy"] == 0.75
    assert row["precision"] == 1.0
    assert row["balanced_accuracy"] == 0.75


def test_golden_at_k(spark):
    df = scores(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.2, 0.1, 0.05])
    row = metrics.lift_curve(df, "y", "s", "id", [0.5]).first()
    assert row["precision_at_k"] == pytest.approx(2 / 3)
    assert row["recall_at_k"] == pytest.approx(2 / 3)
    assert row["lift_at_k"] == pytest.approx(4 / 3)


def test_against_brute_force_with_ties_and_a_hot_score(spark):
    rng = np.random.default_rng(3)
    n = 900
    s = np.round(rng.random(n), 2)
    s[: n // 3] = 0.5
    rng.shuffle(s)
    y = (rng.random(n) < s).astype(int)
    g = [str(i % 3) for i in range(n)]
    df = scores(spark, y, s, g).repartition(7)
    for row in metrics.metrics_report(df, "y", "s", by=["g"]).collect():
        mine = [i for i in range(n) if g[i] == row["g"]]
        assert row["roc_auc"] == pytest.approx(brute_auc(y[mine], s[mine]))
        assert row["pr_auc"] == pytest.approx(brute_ap(y[mine], s[mine]))
    ks = [0.01, 0.1, 0.45, 0.6, 17, n]
    for row in metrics.lift_curve(df, "y", "s", "id", ks).collect():
        size = int(np.ceil(n * row["k"])) if row["k"] < 1 else int(row["k"])
        assert row["size"] == size
        hits = brute_at_k(y, s, size)
        assert row["precision_at_k"] == pytest.approx(hits / size)
        assert row["recall_at_k"] == pytest.approx(hits / y.sum())
        assert row["lift_at_k"] == pytest.approx(hits / size / y.mean())


def test_lift_per_group_cuts_every_group(spark):
    rng = np.random.default_rng(5)
    n = 300
    s, y = np.round(rng.random(n), 1), rng.integers(0, 2, n)
    g = [str(i % 2) for i in range(n)]
    found = metrics.lift_curve(scores(spark, y, s, g), "y", "s", "id", [0.1, 0.3], by=["g"]).collect()
    assert len(found) == 4
    for row in found:
        mine = np.array([i for i in range(n) if g[i] == row["g"]])
        hits = brute_at_k(y[mine], s[mine], row["size"])
        assert row["precision_at_k"] == pytest.approx(hits / row["size"])


def test_one_class_only(spark):
    none = scores(spark, [0, 0, 0], [0.2, 0.6, 0.7])
    row = metrics.metrics_report(none, "y", "s").first()
    assert row["roc_auc"] is None and row["precision"] == 0 and row["recall"] == 0 and row["f1"] == 0
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 2, 0, 0)
    assert row["balanced_accuracy"] == pytest.approx(1 / 3)
    lift = metrics.lift_curve(none, "y", "s", "id", [0.5]).first()
    assert lift["recall_at_k"] == 0 and lift["lift_at_k"] == 0


@pytest.mark.parametrize("k", [0.0, 1.5, -0.1, 0, -3, "0.1", True])
def test_bad_k(k):
    with pytest.raises(ValueError):
        metrics.rows_at_k(k, F.lit(5))


def test_k_above_row_count(spark):
    with pytest.raises(Exception, match="k as int must be in"):
        metrics.lift_curve(scores(spark, [0, 1], [0.1, 0.2]), "y", "s", "id", [3]).collect()


def test_threshold_by_kind():
    assert metrics.score_threshold("probability") == 0.5
    assert metrics.score_threshold("decision") == 0.0
    with pytest.raises(ValueError):
        metrics.score_threshold("logit")


def test_number_rows_and_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(v), str(i % 4)) for i, v in enumerate(rng.permutation(2000))]
    df = spark.createDataFrame(rows, "id long, v double, g string").repartition(9)
    ranked = number_rows(df, F.desc("v")).collect()
    assert all(r["rank"] == 2000 - r["v"] for r in ranked)
    totals = running_totals(df, ["v"], ["id"], by=["g"]).collect()
    for g in "0123":
        part = sorted((r for r in rows if r[2] == g), key=lambda r: r[1])
        want, sums = 0, {}
        for r in part:
            want += r[0]
            sums[r[1]] = want
        mine = [r for r in totals if r["g"] == g]
        assert {r["v"]: r["cum_id"] for r in mine} == sums
        assert {r["total_id"] for r in mine} == {want}


def test_partitioning_does_not_change_results(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    df = scores(spark, y, s)
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = metrics.lift_curve(df.orderBy(F.rand(1)), "y", "s", "id").orderBy("k").collect()
        results.append(([tuple(r) for r in found], tuple(metrics.metrics_report(df, "y", "s").first())))
    assert results[0][0] == results[1][0]
    assert results[0][1] == pytest.approx(results[1][1])


def test_null_groups_and_scores_that_are_no_numbers(spark):
    rows = [(g, i, float(i % 7) / 7, i % 2) for g in ("a", None) for i in range(40)]
    odd = [(g, 100 + i, s, 1) for g in ("a", None) for i, s in enumerate((float("nan"), None, float("inf")))]
    df = spark.createDataFrame(rows + odd, "g string, id long, score double, label int")
    clean = spark.createDataFrame(rows, "g string, id long, score double, label int")
    report = metrics.metrics_report(df, "label", "score", 0.5, ["g"])
    assert sorted(map(str, report.collect())) == sorted(map(str, metrics.metrics_report(clean, "label", "score", 0.5, ["g"]).collect()))
    assert {r.g for r in report.collect()} == {"a", None}
    confused = metrics.confusion(df, "label", "score", 0.5, ["g"]).collect()
    assert len(confused) == 2 and all(r.tn + r.fp + r.fn + r.tp == 40 for r in confused)
    curve = metrics.lift_curve(df, "label", "score", "id", [0.1, 7], ["g"]).collect()
    assert len(curve) == 4 and {r.g for r in curve} == {"a", None}


def test_lift_tells_counts_from_shares(spark):
    df = scores(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6])
    found = {(r.k, r.kind): (r["size"], r.recall_at_k) for r in metrics.lift_curve(df, "y", "s", "id", [1, 1.0, 2]).collect()}
    assert found == {(1.0, "count"): (1, 0.5), (1.0, "share"): (4, 1.0), (2.0, "count"): (2, 0.5)}
