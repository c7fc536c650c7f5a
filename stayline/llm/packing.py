"""Pack token sequences by length patterns fitted to the length histogram."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stored

SEQUENCE_TOKENS = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
FIT_PASSES = 80
_encoders: dict = {}


def encoder(json_path: str, ranks_path: str):
    """A function from text to ids, the same ids as `tokenizers` gives with the json file.

    Both files hold one vocabulary. The ranks go through tiktoken, which is
    several times faster; a text that holds a special token's string goes
    through `tokenizers` itself.
    """
    if json_path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(json_path)

        def encode(text: str) -> list[int]:
            if SPECIAL in text:
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[json_path] = encode
    return _encoders[json_path]


def pieces(docs: DataFrame, size: int, json_path: str, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """Every document's ids and an end id, cut into pieces of `size` from the end, so only the first may be shorter.

    `task` and `slot` number the pieces of one length within a task; they mean
    something only once the table is written.
    """
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, task int, slot long" + (", ids array<int>" if with_ids else "")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen = encoder(json_path, ranks_path), Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text if isinstance(text, str) else ""), END_ID], dtype="<u4")
                ends = range(len(ids) % size or size, len(ids) + 1, size) if len(ids) > size else [len(ids)]
                start = 0
                for piece, end in enumerate(ends):
                    part = ids[start:end]
                    row = (doc_id, piece, start, end - start, zlib.crc32(part.tobytes()), task, seen[end - start])
                    rows.append((*row, part.astype("i4")) if with_ids else row)
                    seen[end - start] += 1
                    start = end
                held += len(ids)
                if held > 2_000_000:
                    yield frame(rows, names)
                    rows, held = [], 0
            if rows:
                yield frame(rows, names)

    def frame(rows, names):
        return pd.DataFrame(rows, columns=names)

    # Ids travel as text, since pandas turns whole numbers beside nulls into floats.
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(cut, schema)


def fit_patterns(histogram: np.ndarray, size: int, passes: int = FIT_PASSES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of one to three lengths that fill `size` exactly, with whole repeat counts.

    Non-negative least squares: minimise the squared difference between the
    histogram and the pieces that the patterns use. Solved by coordinate
    descent that always takes the steepest patterns first, which leaves most
    counts at zero; counts are rounded down and never use a piece twice.
    """
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    plan = [((size,), int(histogram[size]))] if histogram[size] else []
    present = histogram > 0
    shapes = []
    for low in have[have <= size // 2]:
        if low * 2 <= size and present[size - low] and size - low >= low:
            shapes.append((low, size - low, 0))
        middle = have[(have >= low) & (have * 2 <= size - low)]
        last = size - low - middle
        ok = present[last]
        if ok.any():
            shapes.extend(zip([low] * int(ok.sum()), middle[ok], last[ok], strict=True))
    if not shapes:
        return plan
    patterns = np.array(shapes, dtype=np.int64)
    left = histogram.astype(float)
    left[size] = 0
    left[0] = 0
    counts = np.zeros(len(patterns))
    # Uses of a length by a pattern; index 0 is the empty place.
    uses = [Counter(int(x) for x in p if x) for p in patterns] if len(patterns) < 1000 else None
    for _ in range(passes):
        slope = left[patterns].sum(axis=1)
        steep = np.argpartition(-slope, min(512, len(slope) - 1))[:512]
        steep = steep[np.argsort(-slope[steep], kind="stable")]
        moved = 0.0
        for at in steep:
            use = uses[at] if uses else Counter(int(x) for x in patterns[at] if x)
            step = sum(left[x] * n for x, n in use.items()) / sum(n * n for n in use.values())
            step = max(step, -counts[at])
            if abs(step) < 0.5:
                continue
            counts[at] += step
            moved += abs(step)
            for x, n in use.items():
                left[x] -= step * n
        if moved < 1:
            break
    rest = histogram.astype(np.int64).copy()
    for at in np.argsort(-counts, kind="stable"):
        if counts[at] < 0.5:
            break
        use = Counter(int(x) for x in patterns[at] if x)
        times = min(int(counts[at] + 0.5), *(int(rest[x]) // n for x, n in use.items()))
        if times:
            plan.append((tuple(sorted(use.elements(), reverse=True)), times))
            for x, n in use.items():
                rest[x] -= times * n
    return plan


def pack_rest(rest: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over whole groups of equal pieces and equal open sequences."""
    room: dict[int, list[list]] = {}  # free tokens -> [lengths, count]
    free = np.zeros(size + 1, dtype=np.int64)

    def put(space: int, lengths: tuple[int, ...], count: int) -> None:
        room.setdefault(space, []).append([lengths, count])
        free[space] += count

    for length in np.flatnonzero(rest)[::-1]:
        length, todo = int(length), int(rest[length])
        while todo and length:
            fitting = np.flatnonzero(free[length:])
            if len(fitting):
                space = length + int(fitting[0])
                lengths, count = group = room[space][-1]
                used = min(todo, count)
                group[1] -= used
                if not group[1]:
                    room[space].pop()
                free[space] -= used
                put(space - length, (*lengths, length), used)
                todo -= used
            else:
                each = size // length
                full, more = divmod(todo, each)
                if full:
                    put(size - each * length, (length,) * each, full)
                if more:
                    put(size - more * length, (length,) * more, 1)
                todo = 0
    return [(lengths, count) for groups in room.values() for lengths, count in groups if count]


def packing_plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences); every piece of the histogram is used once."""
    plan = fit_patterns(histogram, size)
    rest = histogram.astype(np.int64).copy()
    rest[0] = 0
    for lengths, count in plan:
        for length in lengths:
            rest[length] -= count
    return plan + pack_rest(rest, size)


def placements(plan: list[tuple[tuple[int, ...], int]], size: int):
    """For each length: first ranks of its runs, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(size + 1, dtype=np.int64)
    sequence = 0
    for lengths, count in plan:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) for length, found in runs.items()}


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Place all documents into sequences of at most `size` tokens.

    Documents become pieces; the histogram of piece lengths (at most `size`
    rows, the only thing the driver sees) is fitted by patterns; every piece
    is ranked among those of its length by adding counts of earlier tasks to
    its number inside its task; rank and length give sequence and offset. No
    row moves for the packing but thin ones, whatever length is frequent.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with `with_ids`, the ids. Null texts are empty documents (the end id
    alone), null ids stay null, repeated rows are packed each, other columns
    are not looked at, and no documents give no rows.
    """
    if json_path is None:
        import public_tokenizers

        json_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = stored(pieces(docs, size, json_path, ranks_path, with_ids), "pieces")
    counts = stored(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    runs = placements(packing_plan(histogram, size), size)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "task", earlier.alias("base"))
    names = [c for c in cut.columns if c not in ("task", "slot")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                first, starts, offsets = runs[int(length[rows[0]])]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = starts[run] + rank[rows] - first[run]
                offset[rows] = offsets[run]
            yield batch[names].assign(sequence_id=sequence, offset=offset)

    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("slot") + F.col("base"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return ranked.select(*names, "rank").mapInPandas(place, f"{schema}, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))
