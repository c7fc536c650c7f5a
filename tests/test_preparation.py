import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayline.fields import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from stayline.operators import preparation, splits
from stayline.operators.quantiles import exact_medians


def column(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


@pytest.mark.parametrize(
    "values, median",
    [([1, 2, 3, 10], 2.5), ([5], 5), ([1, None, float("nan"), 3], 2), ([0, 0, 0, 1], 0), ([None, None], None)],
)
def test_median_cases(spark, values, median):
    assert exact_medians(column(spark, values), ["v"])["v"] == median


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=300))
def test_median_property(spark, values):
    assert exact_medians(column(spark, values), ["v"])["v"] == pytest.approx(float(np.median(values)), abs=1e-9)


def test_median_of_many_rows_with_a_hot_value(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(4) * 20).alias("a"), (F.hash("id") % 1000).cast("double").alias("b")
    ).withColumn("c", F.lit(None).cast("double"))
    frozen = df.persist()
    pdf = frozen.toPandas()
    medians = exact_medians(frozen, ["a", "b", "c"])
    assert medians["a"] == pytest.approx(pdf["a"].median())
    assert medians["b"] == pytest.approx(pdf["b"].median())
    assert medians["c"] is None


def customers(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [
        (i, *[None if (i + j) % 13 == 0 else float(rng.integers(0, 50)) for j in range(8)], ["France", "Spain", "Germany"][i % 3], ["Male", "Female"][i % 2])
        for i in range(n)
    ]
    names = ", ".join(f"{c} double" for c in NUMERIC_FEATURES)
    return spark.createDataFrame(rows, f"CustomerId long, {names}, Geography string, Gender string")


def test_preparation_matches_numpy(spark):
    df = customers(spark)
    pdf = df.toPandas()
    prepared = preparation.fit_preparation(df)
    numbers = pdf[NUMERIC_FEATURES].fillna(pdf[NUMERIC_FEATURES].median())
    want = (numbers - numbers.mean()) / numbers.std(ddof=0)
    assert prepared.names == NUMERIC_FEATURES + ["Geography_France", "Geography_Germany", "Geography_Spain", "Gender_Female", "Gender_Male"]
    got = prepared.assemble(df).select("CustomerId", vector_to_array("features").alias("x")).orderBy("CustomerId").collect()
    matrix = np.array([r["x"] for r in got])
    assert np.allclose(matrix[:, :8], want.values)
    assert np.allclose(matrix[:, 8:11].sum(axis=1), 1)
    assert np.allclose(matrix[:, 9], pdf["Geography"] == "Germany")


def test_constant_column_is_divided_by_one(spark):
    df = customers(spark).withColumn("Age", F.lit(4.0))
    prepared = preparation.fit_preparation(df)
    assert {r["Age"] for r in prepared.scaled(df).select("Age").collect()} == {0.0}


def test_unknown_category_is_all_zero(spark):
    df = customers(spark)
    prepared = preparation.fit_preparation(df)
    odd = df.withColumn("Geography", F.when(F.col("CustomerId") == 0, "Atlantis")).filter("CustomerId < 2")
    rows = prepared.one_hot(odd).select(*[c for c in prepared.names if c.startswith("Geo")]).collect()
    assert all(sum(r) == 0 for r in rows)


def test_quoted_levels_survive_the_model(spark, tmp_path):
    df = customers(spark).withColumn("Gender", F.lit("it's \\ odd, `or` \"so\""))
    prepared = preparation.fit_preparation(df)
    PipelineModel(stages=prepared.stages()).save(str(tmp_path / "prepared"))
    loaded = PipelineModel.load(str(tmp_path / "prepared")).transform(df)
    for made in (prepared.assemble(df), loaded):
        assert made.select(F.sum(vector_to_array("features")[11])).first()[0] == 60


def test_many_levels(spark):
    many = spark.range(1200).select(F.col("id").cast("string").alias("Geography"), F.lit("x").alias("Gender"))
    levels = preparation.fit_categories(many)
    assert len(levels["Geography"]) == 1200 and levels["Gender"] == ["x"]
    prepared = preparation.Preparation({}, {}, {}, levels)
    odd = many.union(spark.createDataFrame([("nowhere", "x"), (None, None)], "Geography string, Gender string"))
    flags = prepared.assemble(odd).select("Geography", vector_to_array("features").alias("x"))
    wide = flags.select("Geography", F.size("x").alias("n"), F.aggregate(F.slice("x", 1, 1200), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert {(r["n"], r["s"]) for r in wide.filter("try_cast(Geography as int) >= 0").collect()} == {(1201, 1.0)}
    assert [r["s"] for r in wide.filter("coalesce(Geography, 'nowhere') = 'nowhere'").collect()] == [0.0, 0.0]


def test_columns(spark):
    df = customers(spark)
    assert preparation.missing_columns(df.drop("Age", "Gender")) == ["Gender", "Age"]
    with pytest.raises(ValueError, match="Age"):
        preparation.select_features(df.drop("Age"))
    assert preparation.select_features(df).columns == NUMERIC_FEATURES + CATEGORICAL_FEATURES
    aligned = preparation.align_columns(df, ["Age", "Geography_Mars"])
    assert aligned.columns == ["Age", "Geography_Mars"] and aligned.first()["Geography_Mars"] == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 20 + [(0,)] * 80, "y int")
    assert {r["y"]: r["weight"] for r in preparation.class_weights(df, "y").collect()} == {1: 2.5, 0: 0.625}
    assert preparation.with_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(100)
    many = spark.range(3000).select((F.col("id") % 1500).alias("y"))
    assert {r["weight"] for r in preparation.with_class_weights(many, "y").collect()} == {1.0}


def brute_ranks(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500])
def test_split_and_folds_by_brute_force(spark, n):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "id long, y int")
    cuts = splits.split_cuts(df, "id", "y")
    got = {r["id"]: r["split"] for r in splits.with_split(df, cuts).collect()}
    folds = {r["id"]: r["fold"] for r in splits.with_folds(df, splits.fold_cuts(df, "id", "y")).collect()}
    for label in (0, 1):
        ids = [i for i in range(n) if int(i % 4 == 0) == label]
        order = brute_ranks(ids)
        size = round(0.2 * len(ids))
        assert {i for i in ids if got[i] == "test"} == set(order[:size])
        assert [folds[i] for i in order] == [r * 3 // len(ids) for r in range(len(ids))]
    whole = {r["id"]: r["split"] for r in splits.with_split(df, splits.split_cuts(df, "id")).collect()}
    assert {i for i, s in whole.items() if s == "test"} == set(brute_ranks(range(n))[: round(0.2 * n)])


def test_split_keeps_copies_together_and_takes_many_classes(spark):
    df = spark.createDataFrame([(i % 40, 0) for i in range(400)] + [(5, 0)] * 300, "id long, y int")
    marked = splits.with_split(df, splits.split_cuts(df, "id", "y"))
    assert marked.select("id", "split").distinct().count() == 40
    many = spark.range(1500).select("id", (F.col("id") % 150).alias("y"))
    sizes = splits.with_split(many, splits.split_cuts(many, "id", "y")).filter("split = 'test'").groupBy("y").count()
    assert sizes.count() == 150 and {r["count"] for r in sizes.collect()} == {2}


def test_split_refuses_rows_without_label(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id long, y int")
    with pytest.raises(ValueError, match="without a value"):
        splits.split_cuts(df, "id", "y")
    lost = spark.createDataFrame([(1, 0), (None, 0)], "id long, y int")
    with pytest.raises(ValueError, match="'id' has rows without a value"):
        splits.split_cuts(lost, "id", "y")


def test_one_search_gives_the_split_and_the_folds_of_two(spark):
    df = spark.range(997).select(F.col("id"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("y"))
    split, inner = splits.split_and_fold_cuts(df, "id", "y", folds=4)
    train, test = splits.train_test(df, split)
    apart = splits.split_cuts(df, "id", "y")
    old_train, old_test = splits.train_test(df, apart)
    assert {r["id"] for r in test.collect()} == {r["id"] for r in old_test.collect()}
    want = splits.with_folds(old_train, splits.fold_cuts(old_train, "id", "y", 4)).collect()
    assert {(r["id"], r["fold"]) for r in splits.with_folds(train, inner).collect()} == {(r["id"], r["fold"]) for r in want}


def test_cuts_are_the_hash_order_of_each_stratum(spark):
    rows = [(i, f"s{i % 5}") for i in range(400)] + [(1000, "alone"), (1001, "pair"), (1002, "pair")]
    df = spark.createDataFrame(rows, "id long, s string")
    marked = {r["id"]: r["split"] for r in splits.with_split(df, splits.split_cuts(df, "id", "s", 0.3)).collect()}
    for stratum in {s for _, s in rows}:
        ordered = sorted((hashlib.md5(f"42-{i}".encode()).hexdigest(), i) for i, s in rows if s == stratum)
        n = int(len(ordered) * 0.3 + 0.5)
        assert [marked[i] for _, i in ordered] == ["test"] * n + ["train"] * (len(ordered) - n)


def test_moments_of_filled_columns(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 4 != 0, (F.col("id") * 37 % 1009).cast("double")).alias("a"), F.lit(3.0).alias("b")
    )
    medians, means, deviations = preparation.fit_numbers(df, ["a", "b"])
    filled = df.toPandas().fillna(medians)
    assert medians["a"] == float(df.toPandas()["a"].median())
    for c in ("a", "b"):
        assert means[c] == pytest.approx(filled[c].mean()) and deviations[c] == pytest.approx(filled[c].std(ddof=0))


def test_median_when_the_bracket_misses(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"))
    known = preparation.profiles(df, ["a"])["a"]
    wrong = {"a": type(known)(known.rows, known.values, known.mean, known.deviation, 80.0, 90.0)}
    assert exact_medians(df, ["a"], wrong)["a"] == 50.0
