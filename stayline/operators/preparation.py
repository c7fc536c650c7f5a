"""Feature preparation: column choice, imputation, scaling, one-hot, class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.fields import CATEGORICAL_FEATURES, FEATURES, ID_COLUMNS, NUMERIC_FEATURES, REQUIRED_FIELDS
from stayline.functions.numbers import finite
from stayline.operators.quantiles import Profile, exact_medians, profiles
from stayline.session import stored


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> list[str]:
    """Required columns the table lacks, in their own order. Runs no job."""
    return [name for name in required if name not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def drop_ids(df: DataFrame) -> DataFrame:
    return df.drop(*ID_COLUMNS)


def select_features(df: DataFrame) -> DataFrame:
    """Features only, numeric then categorical."""
    return require_columns(df, FEATURES).select(*FEATURES)


def model_input(df: DataFrame) -> DataFrame:
    """The fields a model may see, in record order; ids never."""
    return require_columns(df).select(*REQUIRED_FIELDS)


def align_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order: absent ones are 0, extra ones go."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(0.0).alias(n) for n in names])


def sql_number(value: float) -> str:
    return f"{value!r}D"


@dataclass(frozen=True)
class Preparation:
    """What was learned from the training set, and how to apply it.

    Numbers are filled and scaled by SQL expressions, levels are indexed and
    encoded as sparse flags; the same stages work on a DataFrame and inside a
    saved Spark ML model. A column may have any number of levels: like a
    model's coefficients, their names are kept once on the driver.
    """

    medians: Mapping[str, float]
    means: Mapping[str, float]
    deviations: Mapping[str, float]
    categories: Mapping[str, list[str]]

    @property
    def names(self) -> list[str]:
        """Names of the model matrix columns, in order."""
        return list(self.means) + [f"{c}_{level}" for c, levels in self.categories.items() for level in levels]

    def filled(self, name: str) -> str:
        """Column with null and NaN replaced by the training median."""
        return f"coalesce(nanvl(`{name}`, CAST(NULL AS DOUBLE)), {sql_number(self.medians[name])})"

    def expressions(self, impute: bool = True) -> list[str]:
        """The scaled numbers as x_ columns."""
        return [
            f"({self.filled(c) if impute else f'`{c}`'} - {sql_number(self.means[c])})"
            f" / {sql_number(self.deviations[c] or 1.0)} AS `x_{c}`"
            for c in self.means
        ]

    def stages(self, impute: bool = True, column: str = "features") -> list:
        """Fitted Spark ML stages from raw features to the model matrix row."""
        from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
        from pyspark.sql import SparkSession

        statement = "SELECT *, " + ", ".join(self.expressions(impute) or ["1 AS `x_`"]) + " FROM __THIS__"
        steps = [SQLTransformer(statement=statement)]
        # A column without any level has no flags.
        coded = [c for c, levels in self.categories.items() if levels]
        flags = [f"x_{c}" for c in coded]
        if coded:
            # Unknown levels and nulls get the index behind the last level, whose flag is dropped: all zero.
            indexers = [
                StringIndexerModel.from_labels(self.categories[c], inputCol=c, outputCol=f"i_{c}", handleInvalid="keep")
                for c in coded
            ]
            indexed = SparkSession.active().createDataFrame([], ", ".join(f"`{c}` string" for c in coded))
            for indexer in indexers:
                indexed = indexer.transform(indexed)
            # Sizes come from the column attributes, so this fit runs no job.
            encoder = OneHotEncoder(inputCols=[f"i_{c}" for c in coded], outputCols=flags, dropLast=True, handleInvalid="error")
            steps += [*indexers, encoder.fit(indexed)]
        inputs = [f"x_{c}" for c in self.means] + flags
        return [*steps, VectorAssembler(inputCols=inputs, outputCol=column, handleInvalid="error")]

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(self.filled(c)) for c in self.means})

    def scaled(self, df: DataFrame, impute: bool = True) -> DataFrame:
        """Numeric features replaced by their standardised values."""
        return df.withColumns(
            {
                c: ((F.expr(self.filled(c)) if impute else F.col(c)) - self.means[c]) / (self.deviations[c] or 1.0)
                for c in self.means
            }
        )

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Add one 0/1 column per level; an unknown level or null is all 0."""
        return df.withColumns(
            {
                f"{c}_{level}": F.when(F.col(c) == level, 1.0).otherwise(0.0)
                for c, levels in self.categories.items()
                for level in levels
            }
        )

    def assemble(self, df: DataFrame, impute: bool = True, column: str = "features") -> DataFrame:
        """Add the model matrix row: scaled numbers, then one-hot flags."""
        made = df
        for stage in self.stages(impute, column):
            made = stage.transform(made)
        return made.select(*df.columns, column)


def fit_medians(
    train: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES, known: Mapping[str, Profile] | None = None
) -> dict[str, float]:
    medians = exact_medians(train, columns, known)
    empty = [c for c, m in medians.items() if m is None]
    if empty:
        raise ValueError(f"no values to take a median of: {', '.join(empty)}")
    return medians


def category_levels(train: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Every level of every column once, from one pass: feature, level."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in columns])
    return train.select(F.inline(cells)).filter(F.col("level").isNotNull()).distinct()


def fit_categories(train: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> dict[str, list[str]]:
    """Sorted levels per column. The model that follows holds a number for each, so all are on the driver."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in category_levels(train, columns).toLocalIterator():
        found[row["feature"]].append(row["level"])
    return {c: sorted(levels) for c, levels in found.items()}


def fit_numbers(
    train: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES
) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Medians, and mean and population deviation of the columns once gaps hold the median.

    One aggregation gives the moments of the given values; the rows that get
    the median are then a second group of one value, and the two are combined.
    """
    known = profiles(train, columns)
    medians = fit_medians(train, columns, known)
    means, deviations = {}, {}
    for c in columns:
        given, filled, n = known[c], medians[c], known[c].rows
        gaps = n - given.values
        means[c] = mean = (given.values * given.mean + gaps * filled) / n if gaps else given.mean
        spread = given.deviation**2 + (given.mean - mean) ** 2
        deviations[c] = sqrt((given.values * spread + gaps * (filled - mean) ** 2) / n) if gaps else given.deviation
    return medians, means, deviations


def fit_preparation(train: DataFrame) -> Preparation:
    return Preparation(*fit_numbers(train), fit_categories(train))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows in the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    # One row per class from here on.
    whole = W.partitionBy()
    total = F.sum("n_class").over(whole).cast("double")
    classes = F.count("*").over(whole).cast("double")
    return counts.withColumn("weight", total / (classes * F.col("n_class")))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add the balanced weight of each row's class; null where the label is.

    The weights are a written table: Spark knows its size, broadcasts it while
    it is small and joins by shuffle beyond.
    """
    weights = stored(class_weights(df, label).select(F.col(label).alias("_class"), "weight"), "weights")
    return df.join(weights, F.col(label) == F.col("_class"), "left").drop("_class")
