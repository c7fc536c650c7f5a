import pytest
from pyspark.sql import functions as F

from stayline.fields import NO_ACTION, OFFER_CALL, SEND_EMAIL
from stayline.functions import decisions
from stayline.operators import selection


def results(spark, rows):
    return spark.createDataFrame(
        rows, "index long, id string, email string, p_churn double, recommended_action string, clv double, net_gain double"
    )


def simple(spark, *rows):
    """Rows of (index, id, p)."""
    return results(spark, [(i, d, f"u{i}@example.com", p, SEND_EMAIL, 10.0, 5.0) for i, d, p in rows])


def test_decision_goldens(spark):
    df = spark.createDataFrame([(0.10,), (0.2999,), (0.30,), (0.59,), (0.60,), (None,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(decisions.recommended_action(F.col("p"))).collect()]
    assert got == [NO_ACTION, NO_ACTION, SEND_EMAIL, SEND_EMAIL, OFFER_CALL, None, None]
    values = spark.createDataFrame(
        [(1000.0, 5.0, 2000.0), (-5.0, 3.0, -1.0), (None, None, None), (float("nan"), 1.0, 100.0), (100.0, -4.0, 0.0)],
        "b double, t double, s double",
    )
    clv = [r[0] for r in values.select(decisions.customer_value(F.col("b"), F.col("t"), F.col("s"))).collect()]
    assert clv == [1600, 0, 0, 5, 100]
    assert spark.range(1).select(decisions.net_gain(F.lit(0.4), F.lit(2000.0), F.lit(5.0))).first()[0] == 795


def test_published_scenarios_follow_the_formula(spark):
    rows = [(10000.0, 5.0, 50000.0, 0.2, 3500.0), (4000.0, 2.5, 20000.0, 0.45, 2695.0)]
    df = spark.createDataFrame(rows, "Balance double, Tenure double, EstimatedSalary double, p_churn double, want double")
    for row in decisions.add_decisions(df).collect():
        assert row["net_gain"] == pytest.approx(row["want"] - 0.0 if row["recommended_action"] == NO_ACTION else row["p_churn"] * row["clv"] - 5)


def test_tie_order(spark):
    df = simple(spark, (1, "cust-2", 0.8), (2, "cust-1", 0.8), (10, None, 0.8), (3, " ", 0.8), (4, "z", 0.9))
    got = [r["id"] for r in selection.targets(df, 0.5, 10).orderBy("rank").collect()]
    assert got == ["z", "cust-1", "cust-2", "idx-3", "idx-10"]
    listed = selection.relisted(selection.targets(df, 0.5, 10)).orderBy("position").collect()
    assert [r["id"] for r in listed] == ["cust-1", "cust-2", "z", "idx-3", "idx-10"]


def test_threshold_email_and_cap(spark):
    df = results(
        spark,
        [
            (0, "a", " A@Example.com ", 0.9, None, None, None),
            (1, "b", "nope", 0.95, None, None, None),
            (2, "c", None, 0.99, None, None, None),
            (3, "d", "d@example.com", 0.5, None, None, None),
            (4, "e", "e@example.com", float("nan"), None, None, None),
            (5, "f", "f@example.com", 0.7, None, None, None),
        ],
    )
    assert [r["id"] for r in selection.targets(df, 0.7, 9).orderBy("rank").collect()] == ["a", "f"]
    assert selection.targets(df, 0.7, 9).first()["email"] == "a@example.com"
    assert selection.targets(df, 0.0, 0).count() == 0 and selection.targets(df, 0.0, -2).count() == 0
    assert [r["id"] for r in selection.targets(df, 0.6, 2, require_email=False).orderBy("rank").collect()] == ["c", "b"]
    with pytest.raises(ValueError):
        selection.targets(df, float("nan"), 2)


def test_targets_take_other_probability_columns(spark):
    df = spark.createDataFrame([(0, "a@b.c", "0.9"), (1, "b@b.c", "zz")], "index long, email string, probability string")
    got = selection.targets(df, 0.5, 5).collect()
    assert [(r["id"], r["p_churn"]) for r in got] == [("idx-0", 0.9)]


def test_large_top_n_uses_the_distributed_sort(spark, monkeypatch):
    df = spark.range(500).select(F.col("id"), F.rand(2).alias("v"))
    large = selection.top(df, 120, F.col("v"), F.col("id")).orderBy("rank").collect()
    monkeypatch.setattr(selection, "MAX_EMAILS", 120)
    small = selection.top(df, 120, F.col("v"), F.col("id")).orderBy("rank").collect()
    assert [tuple(r) for r in large] == [tuple(r) for r in small] and len(large) == 120


def candidate_rows(spark):
    return results(
        spark,
        [
            (0, "a", None, 0.10, NO_ACTION, 1.0, 9.0),
            (1, "b", None, 0.40, SEND_EMAIL, 1.0, 3.0),
            (2, "c", None, 0.50, SEND_EMAIL, 1.0, -1.0),
            (3, "d", None, 0.80, OFFER_CALL, 1.0, 0.0),
            (4, "e", None, None, None, 1.0, None),
            (5, "f", None, 0.70, OFFER_CALL, 1.0, 100.0),
        ],
    )


@pytest.mark.parametrize(
    "options, ids",
    [
        ({}, "bdf"),
        ({"email_candidate_rules": {"exclude_no_action": False}}, "abdf"),
        ({"email_selection": {"min_p_churn": "0.5"}}, "df"),
        ({"candidate_selection": {"min_net_gain": -5}}, "bcdf"),
        ({"email_candidates": {"max_candidates": 2}}, "bd"),
        ({"email_candidates": {"max_candidates": -1}}, "bdf"),
        ({"email_candidates": {"max_candidates": 0}}, ""),
        ({"email_candidates": {"allowed_actions": []}}, ""),
        ({"email_candidates": {"allowed_actions": [OFFER_CALL]}}, "df"),
        ({"email_candidate_rules": "x", "email_selection": {"min_p_churn": "bad", "max_candidates": "1"}}, "b"),
    ],
)
def test_candidate_rules(spark, options, ids):
    found = selection.email_candidates(candidate_rows(spark).repartition(3), selection.candidate_rules(options))
    assert "".join(r["id"] for r in found.orderBy("index").collect()) == ids


def test_first_alias_wins():
    rules = selection.candidate_rules({"email_candidates": {"min_p_churn": 1}, "email_candidate_rules": {"min_p_churn": 0.2}})
    assert rules.min_p_churn == 0.2


def test_actions_filter(spark):
    df = candidate_rows(spark)
    assert selection.with_actions(df, [" Retention email "]).count() == 2
    assert selection.with_actions(df, []).count() == selection.with_actions(df, ["  "]).count() == 6
    blank = results(spark, [(0, "a", None, float("inf"), " ", 1.0, 1.0), (1, "b", None, None, "x", 1.0, 1.0), (2, "c", None, 0.3, None, 1.0, 1.0)])
    assert [r["id"] for r in selection.usable(blank).orderBy("index").collect()] == ["b", "c"]


def test_recipients_and_their_errors(spark):
    found = results(
        spark,
        [
            (0, None, None, 0.9, None, None, None),
            (1, " own ", "me@x.org", 0.9, None, None, None),
            (2, "c", None, 0.95, None, None, None),
            (7, "gone", "g@x.org", 0.99, None, None, None),
            (3, "low", None, 0.2, None, None, None),
            (4, "odd", None, 1.2, None, None, None),
        ],
    )
    records = spark.createDataFrame(
        [(0, "r0", "ZERO@x.org"), (1, "r1", "one@x.org"), (2, "r2", "nope"), (3, "r3", "t@x.org"), (4, "r4", "f@x.org")],
        "row_index long, customer_id string, email string",
    )
    got = [(r["rank"], r["id"], r["index"], r["email"]) for r in selection.recipients(found, records).orderBy("rank").collect()]
    assert got == [(1, "r0", 0, "zero@x.org"), (2, "own", 1, "me@x.org")]
    bad = {(r["row_index"], r["id"], r["message"].split()[0]) for r in selection.recipient_errors(found, records).collect()}
    assert bad == {(2, "c", "Selected"), (7, None, "Result")}
    assert selection.recipients(found, records, max_emails=1).count() == 1


def test_metadata_is_merged(spark):
    df = simple(spark, (0, "a", 0.9), (1, "b", 0.8)).withColumn(
        "metadata", F.when(F.col("index") == 0, F.create_map(F.lit("p_churn"), F.lit("old"), F.lit("seg"), F.lit("x")))
    )
    got = [r["metadata"] for r in selection.targets(df, 0.5, 5).orderBy("rank").collect()]
    assert got == [{"seg": "x", "index": "0", "p_churn": "0.9"}, {"index": "1", "p_churn": "0.8"}]


def test_any_number_of_candidates_may_be_asked_for(spark):
    df = spark.range(300).select(
        F.col("id").alias("index"), F.col("id").cast("string").alias("id"), F.lit(0.9).alias("p_churn"), F.lit("call").alias("recommended_action"), F.lit(1.0).alias("net_gain")
    )
    for n, found in ((2_000_000, 300), (120, 120), (50, 50), (0, 0)):
        got = selection.email_candidates(df, selection.CandidateRules(max_candidates=n)).collect()
        assert sorted(r["index"] for r in got) == list(range(found))


def test_errors_name_the_row_and_tell_invalid_from_out_of_range(spark):
    records = spark.createDataFrame([(0, "c0", "a@x.org"), (1, "c1", None), (2, "c2", "b@x.org")], "row_index long, customer_id string, email string")
    rows = [(0, "2", 0.9), (1, "9", 0.9), (2, "two", 0.9), (3, "-1", 0.9), (4, " 1 ", 0.9), (0, None, 0.9), (6, "x", 0.1), (7, "1.5", 0.9)]
    results = spark.createDataFrame([(p, i, None, q) for p, i, q in rows], "position long, index string, id string, p_churn double")
    errors = selection.recipient_errors(results, records, 0.5).collect()
    out, invalid, address = "Result index is out of range", "Result index is invalid", "Selected row is missing"
    messages = sorted((r["row_index"], r["message"].split(" and ")[0].split(" a valid")[0]) for r in errors)
    assert messages == [(1, out), (1, address), (2, invalid), (3, out), (7, invalid)]
    chosen = selection.recipients(results, records, 0.5, 10).orderBy("index").collect()
    assert [(r["index"], r["id"]) for r in chosen] == [(0, "c0"), (2, "c2")]
