"""Lines of text files as rows with their place, and records of CSV files whose quoted cells hold line breaks.

A file is read in blocks by many tasks. Whether a block begins inside a quoted
cell is known only from the blocks before it, so every line is judged under
both assumptions. What a run of lines does to the assumption (keeps it, turns
it round, or settles it whatever it was) combines like a sum: within a block
along its lines, within a file along its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.fields import OPEN_QUOTE
from stayline.operators.ranking import running_totals
from stayline.session import stored

PLACE = ["_file", "_block", "_nth"]
# What a line does to "inside a quoted cell".
KEEPS, TURNS, INTO, OUT_OF = "keeps", "turns", "into", "out of"


def placed_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Lines as `value` with file, block, and a number `_nth` that rises within the block."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_nth"),
    )


def with_offset(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Add the sum of `count` over all rows at earlier places (`PLACE` must be unique).

    Only blocks with their sums are sorted over tasks; inside a block, which a
    single task has read, rows are summed in order.
    """
    inside = W.partitionBy("_file", "_block").orderBy("_nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = rows.groupBy("_file", "_block").agg(F.sum(count).alias("_rows"))
    starts = running_totals(blocks, ["_file", "_block"], ["_rows"]).select("_file", "_block", (F.col("cum__rows") - F.col("_rows")).alias("_before"))
    run = rows.withColumn("_run", F.sum(count).over(inside) - count)
    return run.join(starts, ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_run")).drop("_before", "_run")


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line ends inside a quoted cell when it starts inside one, or at a cell's start.

    Parts between quotes are walked through. A quote opens a cell only at the
    cell's start; within other text it is a plain character; two of them in a
    quoted cell stand for one.
    """
    text, quoted, closed, start = 0, 1, 2, 3
    parts = F.split(line, '"')
    before_quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def step(state: Column, part: Column) -> Column:
        opens = part.endswith(",") | ((part == "") & state.isin(start, closed))
        return F.when(state == quoted, closed).when(opens, quoted).otherwise(text)

    return F.aggregate(before_quotes, F.lit(quoted if inside else start), step) == quoted


def _effect(line: Column) -> Column:
    bare = ~F.contains(line, F.lit('"'))
    from_out, from_in = ends_inside(line, False), ends_inside(line, True)
    settled = F.when(from_out & from_in, INTO).when(~from_out & ~from_in, OUT_OF)
    return F.when(bare, KEEPS).otherwise(F.coalesce(settled, F.when(from_in, KEEPS).otherwise(TURNS)))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any line, taken for itself, ends inside a quoted cell; if none does, every line is a record."""
    lines = spark.read.text(path).where(F.contains("value", F.lit('"')))
    return bool(lines.agg(F.bool_or(ends_inside(F.col("value"), False))).first()[0])


def _after(settled: Column, turns_at: Column, turns: Column, start: Column) -> Column:
    """State after some lines: as last settled, or as at the start, turned round once for every later turn."""
    odd = (turns - F.coalesce(turns_at, F.lit(0))) % 2 == 1
    return F.coalesce(settled, start) != odd


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as `value` with the place of their first line, header and blank lines included.

    Lines go through one shuffle, by block, and are written once. A line that
    is a record by itself is taken as it is; only the lines of longer records
    meet by the place of their first line. A quoted cell that never ends is an
    error that names the file. Lines end in a line feed, with or without a
    carriage return.
    """
    lines = placed_lines(spark, path, "\n").withColumn("_effect", _effect(F.col("value")))
    turn = (F.col("_effect") == TURNS).cast("int")
    settles = F.col("_effect").isin(INTO, OUT_OF)
    upto = W.partitionBy("_file", "_block").orderBy("_nth").rowsBetween(W.unboundedPreceding, W.currentRow)

    # One row per block: how it settles the state, if it does, and its turns up to there and in all. Texts stay behind.
    inside = lines.withColumn("_turns", F.sum(turn).over(upto))
    state = F.struct((F.col("_effect") == INTO).alias("into"), F.col("_turns").alias("turns"))
    last = F.max_by(state, F.when(settles, F.col("_nth")))
    blocks = inside.groupBy("_file", "_block").agg(last.alias("last"), F.max("_turns").alias("turns"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("sum", F.sum("turns").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)))
    settled = F.when(F.col("last").isNotNull(), F.struct(F.col("last.into").alias("into"), (F.col("sum") - F.col("turns") + F.col("last.turns")).alias("turns")))
    known = F.last(settled, ignorenulls=True)
    before = blocks.select("*", known.over(earlier).alias("known"), (F.col("sum") - F.col("turns")).alias("before"))
    before = before.withColumn("starts_inside", _after(F.col("known.into"), F.col("known.turns"), F.col("before"), F.lit(False)))
    starts = stored(before.select("_file", "_block", "starts_inside"), "blocks")

    judged = inside.join(starts, ["_file", "_block"]).withColumn("_settled", F.last(F.when(settles, state), ignorenulls=True).over(upto))
    judged = judged.withColumn("_open", _after(F.col("_settled.into"), F.col("_settled.turns"), F.col("_turns"), F.col("starts_inside")))
    in_order = W.partitionBy("_file", "_block").orderBy("_nth")
    judged = judged.withColumn("_inside", F.coalesce(F.lag("_open").over(in_order), F.col("starts_inside")))
    judged = judged.withColumn("_own", F.last(F.when(~F.col("_inside"), F.col("_nth")), ignorenulls=True).over(upto))
    judged = stored(judged.select("value", *PLACE, "_inside", "_open", "_own"), "judged")

    ends = judged.groupBy("_file", "_block").agg(F.max_by("_open", "_nth").alias("open"), F.max("_own").alias("own"))
    by_file = ends.groupBy("_file").agg(F.max_by("open", "_block").alias("open"))
    unclosed = by_file.where("open").select("_file").first()
    if unclosed:
        raise ValueError(f"{OPEN_QUOTE}: {unclosed[0]}")
    # A record that began in an earlier block: the last line that began one there.
    began = F.last(F.when(F.col("own").isNotNull(), F.struct(F.col("_block").alias("block"), F.col("own").alias("at"))), ignorenulls=True).over(earlier)
    ends = ends.select("_file", "_block", began.alias("began"))
    alone = judged.where(~F.col("_inside") & ~F.col("_open")).select("value", *PLACE)
    parts = judged.where(F.col("_inside") | F.col("_open")).join(ends, ["_file", "_block"])
    first_block = F.when(F.col("_own").isNotNull(), F.col("_block")).otherwise(F.col("began.block"))
    first_at = F.coalesce("_own", F.col("began.at"))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_nth", "value")))
    joined = parts.groupBy("_file", first_block.alias("first_block"), first_at.alias("first_at")).agg(pieces.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    whole = joined.select(text.alias("value"), "_file", F.col("first_block").alias("_block"), F.col("first_at").alias("_nth"))
    return alone.unionByName(whole).withColumn("value", F.regexp_replace("value", "\r$", ""))
