"""What several operators share: table reading, marked keys, connected components."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MARK_BITS = 1 << 27  # at most, 16 MB in every task
MARK_PART = 1 << 15  # bits of a row


def release(df: DataFrame) -> None:
    """Let Spark delete shuffle files that no table needs any more: it does so when their handles are collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


class Marks:
    """A bit for the hash of every key: keys without their bit are not among the marked ones, few others have one.

    The bits are a table of at most 16 MB that is broadcast, however many keys
    there are, so rows are looked up where they lie. `keys` is read twice.
    """

    def __init__(self, keys: DataFrame, name: str):
        # A bit in 32 is set, as long as there is room.
        self.size = min(MARK_BITS, max(MARK_PART, 1 << (32 * keys.count()).bit_length()))
        place = self.place(*[F.col(c) for c in keys.columns])
        parts = keys.select(place.alias("place")).groupBy(F.expr(f"place div {MARK_PART}").alias("part"))
        self.parts = stored(parts.agg(F.expr(f"bitmap_construct_agg(place % {MARK_PART})").alias("bits")), name)

    def place(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.size))

    def told(self, df: DataFrame, name: str, *key: Column) -> DataFrame:
        """`df` with a column `name`: whether the bit of its key is set."""
        rows = df.withColumn("_place", self.place(*key)).withColumn("_part", F.expr(f"_place div {MARK_PART}"))
        parts = self.parts.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
        byte = f"cast(conv(hex(substring(_bits, cast(_place % {MARK_PART} div 8 as int) + 1, 1)), 16, 10) as int)"
        bit = F.expr(f"coalesce(getbit({byte}, cast(_place % 8 as int)) = 1, false)")
        return rows.join(F.broadcast(parts), "_part", "left").select(*[F.col(f"`{c}`") for c in df.columns], bit.alias(name))


def smallest_reachable(yes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches through the links of one block."""
    while True:
        before = left, right
        left = np.minimum(left, np.where(yes, right[None, :], np.iinfo(np.int64).max).min(axis=1))
        right = np.minimum(right, np.where(yes, left[:, None], np.iinfo(np.int64).max).min(axis=0))
        if (left == before[0]).all() and (right == before[1]).all():
            return left, right


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Nodes of an edge table with the smallest node each can reach: (node, component).

    Alternating large-star and small-star rounds. Every round is two
    aggregations and two joins over thin rows; the smallest neighbour of a
    node is found with map-side combining, so a node with a third of all edges
    costs one row per task. Each round's edges are written to the shared
    folder, which cuts the lineage and survives lost executors. Null ends are
    left out. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    current = stored(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct(),
        "edges",
    )
    state = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    if current.isEmpty():
        return spark.createDataFrame([], roots.schema)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
