import pytest
from pyspark.sql import functions as F

from stayline.fields import REQUIRED_FIELDS
from stayline.functions.numbers import number_from_text, probability_source, unit_probability
from stayline.operators import scoring, validation

GOOD = {
    "customer_id": "cust-123",
    "CreditScore": "619",
    "Geography": "France",
    "Gender": "Female",
    "Age": "42",
    "Tenure": "2",
    "Balance": "0",
    "NumOfProducts": "1",
    "HasCrCard": "1",
    "IsActiveMember": "1",
    "EstimatedSalary": "101348.88",
    "email": "one@example.com",
}


def records(spark, *changes):
    rows = [tuple({**GOOD, **c, "row_index": i}[k] for k in ["row_index", *GOOD]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "row_index long, " + ", ".join(f"{k} string" for k in GOOD))


def half(df):
    return df.withColumn("p_churn", F.lit(0.5))


def errors(df, mode="partial"):
    found = validation.error_rows(validation.checked(df), mode).orderBy("row_index", "error_no").collect()
    return [(r["row_index"], r["field"], r["message"]) for r in found]


def status(df, mode):
    return validation.with_status(validation.summary(validation.checked(df), mode)).first().asDict()


def test_missing_fields_hide_bad_casts(spark):
    df = records(spark, {"Age": None, "Gender": "", "Balance": "bad"}, {"Balance": "bad", "Age": "x"})
    assert errors(df) == [
        (0, "Gender", "Missing required field: Gender"),
        (0, "Age", "Missing required field: Age"),
        (1, "Age", "Field 'Age' must be a number (got 'x')"),
        (1, "Balance", "Field 'Balance' must be a number (got 'bad')"),
    ]


def test_absent_column_is_missing_everywhere(spark):
    df = records(spark, {}, {}).drop("Tenure")
    assert errors(df) == [(i, "Tenure", "Missing required field: Tenure") for i in (0, 1)]


def test_quotes_in_messages(spark):
    df = records(spark, {"Age": "it's"}, {"Age": "a\"'b"}, {"Age": "a\\b\n"})
    assert [m for _, _, m in errors(df)] == [
        f"Field 'Age' must be a number (got {raw!r})" for raw in ("it's", "a\"'b", "a\\b\n")
    ]


def test_fail_fast_stops_at_first_bad_row(spark):
    df = records(spark, {}, {"Age": None}, {"Balance": "bad"}, {}).repartition(4)
    assert errors(df, "fail_fast") == [(1, "Age", "Missing required field: Age")]
    got = status(df, "fail_fast")
    assert (got["total_records"], got["valid_records"], got["invalid_records"], got["error_count"], got["status"]) == (4, 1, 1, 1, "error")
    assert scoring.score_batch(df, half, {"mode": "fail_fast"}).results.count() == 0


def test_partial_scores_all_valid_rows(spark):
    df = records(spark, {}, {"Age": None}, {"Balance": "bad", "Age": "?"}, {})
    batch = scoring.score_batch(df, half, {"mode": "partial"})
    assert sorted(r["index"] for r in batch.results.collect()) == [0, 3]
    row = batch.summary.first()
    assert (row["valid_records"], row["invalid_records"], row["error_count"], row["status"]) == (2, 2, 3, "partial")


def test_statuses(spark):
    good, bad = records(spark, {}, {}), records(spark, {"Age": None})
    empty = good.limit(0)
    assert status(good, "fail_fast")["status"] == status(good, "partial")["status"] == "success"
    assert status(bad, "partial")["status"] == "failed" and status(bad, "fail_fast")["status"] == "error"
    assert status(empty, "partial")["status"] == "success" and status(empty, "partial")["error_count"] == 0


def test_default_mode_is_fail_fast_and_unknown_modes_fail(spark):
    df = records(spark, {"Age": None}, {})
    assert scoring.score_batch(df, half).summary.first()["status"] == "error"
    with pytest.raises(ValueError, match="options.mode"):
        scoring.score_batch(df, half, {"mode": "all"})


def test_valid_plus_invalid_is_total_in_any_order(spark):
    changes = [{"Age": [None, "x", "3"][i % 3], "Tenure": ["", "1"][i % 2]} for i in range(60)]
    df = records(spark, *changes)
    for rows in (df, df.orderBy(F.rand(3)).repartition(5)):
        got = status(rows, "partial")
        assert got["valid_records"] + got["invalid_records"] == got["total_records"] == 60
        assert got["valid_records"] == 10


def test_ids(spark):
    df = spark.createDataFrame(
        [(0, " a ", "c", "r"), (1, " ", "c", "r"), (2, None, None, "r"), (3, "", " ", None)],
        "row_index long, id string, customer_id string, row_id string",
    )
    got = df.select(validation.record_id(df).alias("b"), validation.outreach_id(df).alias("o")).collect()
    assert [r["b"] for r in got] == ["c", "c", "r", " "]
    assert [r["o"] for r in got] == ["a", "c", "r", "idx-3"]
    bare = df.select("row_index")
    assert bare.select(validation.record_id(bare).alias("b")).first()["b"] is None


def test_ids_never_reach_the_model(spark):
    seen = []

    def spy(df):
        seen.append([c for c in df.columns if c in REQUIRED_FIELDS])
        return half(df)

    batch = scoring.score_batch(records(spark, {}), spy, {"mode": "partial"})
    assert seen == [REQUIRED_FIELDS] or sorted(seen[0]) == sorted(REQUIRED_FIELDS)
    assert batch.results.first()["id"] == "cust-123"


def test_missing_probability_gives_null_decisions(spark):
    def none(df):
        return df.withColumn("p_churn", F.lit(None).cast("double"))

    batch = scoring.score_batch(records(spark, {}), none, {"mode": "partial"})
    row = batch.results.first()
    assert row["p_churn"] is row["recommended_action"] is row["net_gain"] is row["predicted_label"] is None
    assert row["clv"] == pytest.approx(5067.444)
    assert batch.candidates.count() == 0


def as_python(text):
    import math

    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


SPELLINGS = [
    "1", " 12 ", "+5", "-3.5", "1e3", ".5", "5.", "1E-2", "1_000", "1_0.5_0", " 7 ", "\t8\n", "\x1c9\x1d",
    "", " ", "bad", "1.0d", "1f", "0x10", "1__0", "_1", "1_", "1e", "e5", ".", "+", "1 2", "1,5", "nan", "NaN", "inf",
    "-Infinity", "1e999", "True", "--1", "1e400", "9" * 400, "0.0001e310",
]


def test_spellings_as_python(spark):
    df = spark.createDataFrame([(s,) for s in SPELLINGS], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", number_from_text(F.col("t")).alias("n")).collect()}
    assert got == {s: as_python(s) for s in SPELLINGS}


def test_probability_sources(spark):
    both = spark.createDataFrame([(None, 0.9), (0.2, 0.9)], "p_churn double, probability double")
    assert [r[0] for r in both.select(probability_source(both)).collect()] == [None, 0.2]
    later = spark.createDataFrame([("0.7", 0.9), ("x", 0.9)], "churn_probability string, probability double")
    assert [r[0] for r in later.select(probability_source(later)).collect()] == [0.7, None]
    neither = both.select(F.lit(1).alias("other"))
    assert neither.select(probability_source(neither)).first()[0] is None
    odd = spark.createDataFrame([(float("nan"),), (1.01,), (-0.1,), (0.0,), (1.0,)], "p double")
    assert [r[0] for r in odd.select(unit_probability(odd, "p")).collect()] == [None, None, None, 0.0, 1.0]


def test_summaries_of_many_cases_equal_one_by_one(spark):
    df = records(spark, {}, {"Age": "x"}, {}, {"Gender": "", "Age": None}, {"Balance": "nan"}, {})
    checked = validation.checked(df)
    cases = {"all": F.lit(True), "late": F.col("row_index") >= 2, "good": ~F.col("bad"), "none": F.col("row_index") < 0}
    found = validation.summaries(validation.verdicts(checked), cases).collect()
    got = {(r["records"], r["mode"]): {k: v for k, v in r.asDict().items() if k != "records"} for r in found}
    assert len(got) == 8
    for (name, mode), row in got.items():
        assert row == validation.summary(checked.filter(cases[name]), mode).first().asDict()


def test_fail_fast_with_verdicts_at_hand(spark):
    checked = validation.checked(records(spark, {}, {"Age": "x"}, {"Age": "y"}))
    judged = validation.verdicts(checked)
    assert [r["row_index"] for r in validation.error_rows(checked, "fail_fast", judged).collect()] == [1]
    assert validation.valid_rows(checked, "fail_fast", judged).count() == 0
    assert validation.valid_rows(checked.filter("row_index = 0"), "fail_fast", judged.filter("row_index = 0")).count() == 1
