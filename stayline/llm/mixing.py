"""Mix sources to target weights by hash-random order and exact word budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stored

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3


def sized(docs: DataFrame) -> DataFrame:
    """One thin row per document: doc_id, source, its number of words, a hash of its text.

    A null or empty text has size 0. `group` is the source as a key without nulls.
    """
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("group"),
    )


def targets(rows: DataFrame, weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: group, source_size, target.

    The sources, by code point with null last, get the weights in turn and
    share all words; none gets more than `max_repeats` times its own. A source
    stops at its cap when filling every source up to the level (words per
    weight) of that cap needs no more than all words; the others share what is
    left by weight. The windows here run over one row per source.
    """
    per = rows.groupBy("group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    per = per.withColumn("level", F.col("cap") / F.col("weight"))
    upto, everything = Window.orderBy("level"), Window.partitionBy()
    filled = F.sum("cap").over(upto) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(upto))
    total = F.sum("source_size").over(everything).cast("double")
    per = per.withColumn("total", total).withColumn("full", filled <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return per.select(
        "group",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", left / open_weight * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 17, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How many words of each document the mix takes.

    Documents get a hash-random key, are range-sorted by (source, key), and
    the running sum of words inside each source is cut at the source's budget:
    a source with target T and S words goes round floor(T / S) whole times and
    then in key order up to the word that meets T. Running sums add one total
    per (slice, source) to sums inside a slice, so a source with a third of
    all rows spreads over many tasks and nothing is collected.

    Returns doc_id, source, size, text_hash, source_size, target, taken. Null
    ids are ordinary rows; repeated rows each count, and equal ones may swap
    places; texts without words have size and taken 0; no rows give no rows.
    Other columns of `docs` are not looked at. Reruns agree, since the key
    depends on the id alone and ties are ordered by id, size and text.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs), "sizes")
    goal = targets(rows, weights, max_repeats)
    order = ["key", "doc_id", "size", "text_hash", "tie"]
    keyed = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("tie", F.rand(seed))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = stored(
        keyed.repartitionByRange(slices, "group", *order).withColumn("slice", F.spark_partition_id()),
        "slices",
    )
    before = (
        sliced.groupBy("group", "slice")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(goal, "group")
        .drop("words")
    )
    inside = Window.partitionBy("group", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sliced.withColumn("upto", F.sum("size").over(inside)).join(before, ["group", "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    start = F.col("before") + F.col("upto") - F.col("size")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", rest)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return placed.select("doc_id", "source", "size", "text_hash", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`.

    Shares of a document are rounded to whole documents, so texts stay whole.
    Equal repeated rows share their words evenly. Documents without words,
    and those past the budget, are not in the mix.
    """
    share = (
        mix(docs, weights, seed)
        .groupBy("doc_id", "source", "text_hash", "size")
        .agg((F.sum("taken") / F.count("*")).alias("words"))
        .where("size > 0")
        .select(
            F.col("doc_id").alias("m_id"),
            F.col("source").alias("m_source"),
            F.col("text_hash").alias("m_hash"),
            F.round(F.col("words") / F.col("size")).cast("int").alias("m_copies"),
        )
        .where("m_copies > 0")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.xxhash64("text").alias("d_hash"))
    on = F.col("d_id").eqNullSafe(F.col("m_id")) & F.col("d_source").eqNullSafe(F.col("m_source")) & (F.col("d_hash") == F.col("m_hash"))
    return rows.join(share, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("row.*")
