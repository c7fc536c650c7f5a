"""Stratified splits and folds by the hash of an id.

Rows are ordered by md5 of seed and id. Within each stratum the cut keys are
found from a histogram of hash prefixes, a second one inside the few prefixes
that hold a cut, and an exact look at the small buckets that remain. One
search answers any number of ranks, so test set and folds share it. Cuts are
a table with one row per stratum, so any number of strata will do. Assigning a
row is a join with that table, which Spark broadcasts while it is small: the
rows themselves are then neither shuffled nor sorted. Rows sharing an id stay
together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.session import stored

# Hex digits of the hash per histogram: 4,096 even buckets in a stratum, then 4,096 in each of those.
PREFIX_DIGITS = 3


def hash_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string")))


@dataclass(frozen=True)
class HashCuts:
    """Cut keys per stratum, in a table (part, cuts); a cut without key lies before the first row."""

    id_column: str
    seed: int
    stratum: str | None
    cuts: int
    table: DataFrame

    def between(self, start: int, stop: int) -> HashCuts:
        """Only the cuts from number `start` up to but not `stop`."""
        kept = F.slice("cuts", start + 1, stop - start)
        return replace(self, cuts=stop - start, table=self.table.withColumn("cuts", kept))

    def place(self, df: DataFrame, name: str) -> DataFrame:
        """Add how many cuts lie before the row; null in a stratum without cuts."""
        if self.stratum is None:
            # One row of cuts.
            found = df.withColumn("_cuts", self.table.select("cuts").scalar())
        else:
            table = self.table.select(F.col("part").alias("_part"), F.col("cuts").alias("_cuts"))
            found = df.join(table, F.col(self.stratum) == F.col("_part"), "left")
        key = hash_key(self.id_column, self.seed)
        passed = F.when(F.col("_cuts").isNotNull(), F.lit(0))
        for i in range(self.cuts):
            cut = F.col("_cuts")[i]
            beyond = (key > cut["key"]) | ((key == cut["key"]) & (F.col(self.id_column) > cut["id"]))
            passed = passed + F.when(cut["key"].isNull() | beyond, 1).otherwise(0)
        return found.select(*df.columns, passed.alias(name))


def _place_within(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Add how many rows of the group lie before each bucket, and how many the group has."""
    whole = W.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns({"below": F.coalesce(F.sum("n").over(before), F.lit(0)), "size": F.sum("n").over(whole)})


def _holds(need: Column) -> Column:
    return (need > F.col("below")) & (need <= F.col("below") + F.col("n"))


def find_cuts(
    df: DataFrame, id_column: str, ranks: Callable[[Column], list[Column]], stratum: str | None, seed: int
) -> HashCuts:
    """Find the keys at the given ranks; `ranks` maps a stratum's size to the wanted ranks.

    Two passes over id and label: one counts hash prefixes, the other keeps the
    rows of the prefixes that hold a cut, a 4,096th of the stratum per cut.
    A window sees 4,096 counts or one row in 16 million of a stratum.
    Three tables are written: prefix counts, the kept rows and the cuts.
    """
    part = F.lit("all") if stratum is None else F.col(stratum)
    keyed = df.select(
        part.alias("part"), F.col(id_column).alias("id"), hash_key(id_column, seed).alias("key")
    ).withColumn("coarse", F.substring("key", 1, PREFIX_DIGITS))
    counts = stored(
        keyed.groupBy("part", "coarse").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")),
        "prefixes",
    )
    lost = counts.agg(F.sum("nulls").alias("ids"), F.count_if(F.col("part").isNull()).alias("parts")).first()
    if lost["parts"]:
        raise ValueError(f"'{stratum}' has rows without a value")
    if lost["ids"]:
        raise ValueError(f"'{id_column}' has rows without a value; they cannot be split reproducibly")

    needs = ranks(F.col("size"))
    wanted = F.array(*[F.struct(F.lit(i).alias("cut"), need.cast("long").alias("need")) for i, need in enumerate(needs)])
    coarse = (
        _place_within(counts.drop("nulls"), ["part"], "coarse")
        .select("part", "coarse", "below", "n", F.inline(wanted))
        .filter(_holds(F.col("need")))
        .select("part", "coarse", "cut", (F.col("need") - F.col("below")).alias("need"))
    )
    near = stored(
        keyed.join(coarse, ["part", "coarse"], "left_semi")
        .groupBy("part", "coarse", "key", "id")
        .agg(F.count("*").alias("n"))
        .withColumn("fine", F.substring("key", PREFIX_DIGITS + 1, PREFIX_DIGITS)),
        "near",
    )
    buckets = near.groupBy("part", "coarse", "fine").agg(F.sum("n").alias("n"))
    fine = (
        _place_within(buckets, ["part", "coarse"], "fine")
        .join(coarse, ["part", "coarse"])
        .filter(_holds(F.col("need")))
        .select("part", "coarse", "fine", "cut", (F.col("need") - F.col("below")).alias("need"))
    )
    by_key = W.partitionBy("part", "cut").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    hits = (
        near.join(fine, ["part", "coarse", "fine"])
        .withColumn("cum", F.sum("n").over(by_key))
        .filter((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("n") < F.col("need")))
        .select("part", "cut", "key", "id")
    )
    # Strata are listed beside their cuts: a cut before the first row has no key.
    strata = counts.select("part").distinct()
    found = [F.max(F.when(F.col("cut") == i, F.struct("key", "id"))) for i in range(len(needs))]
    cuts = strata.unionByName(hits, allowMissingColumns=True).groupBy("part").agg(F.array(*found).alias("cuts"))
    return HashCuts(id_column, seed, stratum, len(needs), stored(cuts, "cuts"))


def _test_rank(size: Column, share: float) -> Column:
    return F.floor(size * F.lit(share) + 0.5)


def _fold_ranks(size: Column, folds: int) -> list[Column]:
    return [F.floor((size * j + (folds - 1)) / folds) for j in range(1, folds)]


def split_cuts(
    df: DataFrame, id_column: str, label: str | None = None, test_share: float = 0.2, seed: int = 42
) -> HashCuts:
    """Where the test set ends: `test_share` of every class, or of the table without a label."""
    return find_cuts(df, id_column, lambda size: [_test_rank(size, test_share)], label, seed)


def with_split(df: DataFrame, cuts: HashCuts) -> DataFrame:
    placed = cuts.place(df, "split")
    return placed.withColumn("split", F.when(F.col("split") == 0, "test").otherwise("train"))


def train_test(df: DataFrame, cuts: HashCuts) -> tuple[DataFrame, DataFrame]:
    placed = cuts.place(df, "_passed")
    return placed.filter("_passed = 1").drop("_passed"), placed.filter("_passed = 0").drop("_passed")


def fold_cuts(df: DataFrame, id_column: str, label: str | None, folds: int = 3, seed: int = 42) -> HashCuts:
    """Where each fold but the last ends; sizes within a class differ by one at most."""
    return find_cuts(df, id_column, lambda size: _fold_ranks(size, folds), label, seed)


def split_and_fold_cuts(
    df: DataFrame, id_column: str, label: str | None, test_share: float = 0.2, folds: int = 3, seed: int = 42
) -> tuple[HashCuts, HashCuts]:
    """Where the test set ends and where the folds of the rest end, from one search.

    The same rows as `split_cuts` followed by `fold_cuts` on the training set;
    an id whose copies lie on both sides of the test cut belongs to the test
    set, and the first fold then lacks the copies beyond.
    """

    def ranks(size: Column) -> list[Column]:
        test = _test_rank(size, test_share)
        return [test, *[test + rank for rank in _fold_ranks(size - test, folds)]]

    cuts = find_cuts(df, id_column, ranks, label, seed)
    return cuts.between(0, 1), cuts.between(1, cuts.cuts)


def with_folds(df: DataFrame, cuts: HashCuts) -> DataFrame:
    return cuts.place(df, "fold")
