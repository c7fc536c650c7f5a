"""Scores of whole texts under a Katz backoff model of word pairs, learnt from the same table.

A pair is (word before, word); a text starts behind START and ends with END,
which counts as a token. Counts live in buckets by the word before, so that a
bucket has whole contexts; words that are very frequent are dealt over several
buckets by the word that follows. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import shingles
from stayline.llm.common import release
from stayline.llm.shingles import mix, powers
from stayline.session import scratch_path, stored

FOLDS, HELD_OUT = 10, 0
LOW = 5  # counts up to this are discounted
ADDED = 0.1  # of the base score
CHUNK_TOKENS = 2_000_000  # of documents that travel together
BUCKET_TOKENS = 2_500_000  # that one task counts
HOT_WORDS = 1 << 16  # bound of the list of frequent words that every task holds
START, END = np.uint64(1), np.uint64(2)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
ROW_IDS = 1 << 60  # bucket numbers from here on hold the ids of a chunk


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit values, each in as many byte planes as its largest value needs."""
    parts = []
    for array in arrays:
        array = np.ascontiguousarray(array)
        array = array.view("<u8") if array.dtype == np.float64 else array.astype("<u8")
        width = (int(array.max()).bit_length() + 7) // 8 if len(array) else 0
        parts += [np.array([len(array), width], dtype="<u8").tobytes(), array.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        planes = np.zeros((n, 8), dtype=np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(planes.reshape(-1).view("<u8"))
        at += 16 + n * width
    return out


def hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], shingles._IS_WORD[data])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(shingles._VALUE[data] * powers(shingles._BASE, len(data)), dtype=np.uint64)))
    words = mix((total[ends] - total[starts]) * powers(shingles._INVERSE, len(data))[starts])
    return np.split(words, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))[:-1])


def text_hashes(texts) -> Iterator[np.ndarray]:
    """Word hashes per text; many texts go through together, a very long one in parts cut at blanks."""
    waiting, held = [], 0
    for text in texts:
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        if len(raw) > shingles.CHUNK_BYTES:
            yield from hashes(waiting) if waiting else []
            waiting, held, parts, start = [], 0, [], 0
            while start <= len(raw):
                cut = BLANK.search(raw, start + shingles.CHUNK_BYTES)
                parts += hashes([raw[start : cut.start() if cut else len(raw)]])
                start = cut.end() if cut else len(raw) + 1
            yield np.concatenate(parts)
            continue
        waiting.append(raw)
        held += len(raw)
        if held > shingles.CHUNK_BYTES:
            yield from hashes(waiting)
            waiting, held = [], 0
    yield from hashes(waiting) if waiting else []


@dataclass
class Chunk:
    """Documents that a task reads one after the other, with all their pairs."""

    number: int
    ids: list
    learn: np.ndarray
    held_out: np.ndarray
    lengths: np.ndarray  # tokens, END included
    before: np.ndarray
    after: np.ndarray

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.lengths)


def chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[Chunk]:
    task, number = TaskContext.get().partitionId(), 0
    ids, learn, held_out, words, tokens = [], [], [], [], 0

    def chunk():
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        before, after = np.empty(tokens, dtype=np.uint64), np.empty(tokens, dtype=np.uint64)
        ends = np.cumsum(lengths)
        inside = np.ones(tokens, dtype=bool)
        inside[ends - 1] = False
        flat = np.concatenate(words)
        after[inside], after[ends - 1] = flat, END
        inside[:] = True
        inside[ends - lengths] = False
        before[inside], before[ends - lengths] = flat, START
        return Chunk(task << 32 | number, ids, np.array(learn, dtype=bool), np.array(held_out, dtype=bool), lengths, before, after)

    for batch in batches:
        for doc_id, learnt, held, found in zip(batch["doc_id"], batch["learn"], batch["held_out"], text_hashes(batch["text"]), strict=True):
            ids.append(doc_id)
            learn.append(learnt)
            held_out.append(held)
            words.append(found)
            tokens += len(found) + 1
            if tokens >= size:
                yield chunk()
                number += 1
                ids, learn, held_out, words, tokens = [], [], [], [], 0
    if ids:
        yield chunk()


@dataclass
class Deal:
    """Which bucket a pair goes to. Frequent words before have buckets of their own, by the word after."""

    buckets: int
    hot: np.ndarray  # sorted hashes
    count: np.ndarray  # learnt tokens behind each
    first: np.ndarray
    parts: np.ndarray

    def plain(self, words: np.ndarray) -> np.ndarray:
        """Bucket of a word that is not frequent; rises with the hash."""
        return ((words >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are frequent, and their places in the list."""
        if not len(self.hot):
            return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return self.hot[at] == words, at

    def of(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        is_hot, at = self.find(before)
        bucket = self.plain(before)
        at = at[is_hot]
        bucket[is_hot] = self.first[at] + (mix(after[is_hot]) % self.parts[at].astype(np.uint64)).astype(np.int64)
        return bucket


def plan(rows: DataFrame, chunk_tokens: int, bucket_tokens: int) -> tuple[Deal, int]:
    """Number of buckets and the frequent words with their exact counts; and how many documents are learnt from.

    Words that are rare in a chunk are not told, so at most HOT_WORDS come from
    each. A word is frequent if its told count is half a bucket and a
    HOT_WORDSth of all tokens.
    """

    def tell(batches):
        for chunk in chunks(batches, chunk_tokens):
            learnt = chunk.learn[chunk.documents()]
            words, counts = np.unique(chunk.before[learnt & (chunk.before != START)], return_counts=True)
            often = counts >= max(len(learnt) // HOT_WORDS, 1)
            totals = pd.DataFrame({"word": [0, int(START)], "n": [len(learnt), int(chunk.learn.sum())]})
            yield pd.concat([totals, pd.DataFrame({"word": words[often].view(np.int64), "n": counts[often]})])

    told = stored(rows.mapInPandas(tell, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "told")
    totals = {r["word"]: r["n"] for r in told.where(F.col("word").isin(0, int(START))).collect()}
    tokens, documents = totals.get(0, 0), totals.get(int(START), 0)
    least = max(bucket_tokens // 2, tokens // HOT_WORDS, 1)
    found = told.where((F.col("n") >= least) & (F.col("word") != 0)).toPandas()
    hot = np.sort(found["word"].to_numpy(dtype=np.int64).view(np.uint64))
    count = np.zeros(len(hot), dtype=np.int64)
    if len(hot):

        def again(batches):
            total = np.zeros(len(hot), dtype=np.int64)
            for chunk in chunks(batches, chunk_tokens):
                words = chunk.before[chunk.learn[chunk.documents()]]
                at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                total += np.bincount(at[hot[at] == words], minlength=len(hot))
            yield pd.DataFrame({"place": np.arange(len(hot)), "n": total})

        for r in rows.mapInPandas(again, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            count[r["place"]] = r["n"]
    buckets = max(1, -(-(tokens - int(count.sum())) // bucket_tokens))
    parts = np.maximum(1, -(-count // bucket_tokens))
    return Deal(buckets, hot, count, buckets + np.cumsum(parts) - parts, parts), documents


def dealt(rows: DataFrame, deal: Deal, chunk_tokens: int) -> DataFrame:
    """Pairs of every chunk by bucket, and the ids of its documents; equal pairs of a chunk are told once."""

    def read(batches):
        for chunk in chunks(batches, chunk_tokens):
            place = chunk.documents() * 2 + chunk.learn[chunk.documents()]
            bucket = deal.of(chunk.before, chunk.after)
            order = np.lexsort((chunk.after, chunk.before, bucket))
            bucket, before, after, place = bucket[order], chunk.before[order], chunk.after[order], place[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            out = [(int(bucket[i]), chunk.number, shrunk(before[i:j], after[i:j], place[i:j]), None) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            out.append((ROW_IDS + chunk.number, chunk.number, packed(chunk.lengths, chunk.held_out), chunk.ids))
            yield pd.DataFrame(out, columns=["bucket", "chunk", "blob", "ids"])

    return rows.mapInPandas(read, "bucket long, chunk long, blob binary, ids array<string>")


def shrunk(before: np.ndarray, after: np.ndarray, place: np.ndarray) -> bytes:
    """Sorted pairs as words before, pairs of each, words after, their places in that list, and documents of each pair."""
    new_word = np.concatenate(([True], before[1:] != before[:-1]))
    new_pair = new_word | np.concatenate(([True], after[1:] != after[:-1]))
    first = np.flatnonzero(new_pair)
    words, at = np.unique(after[first], return_inverse=True)
    return packed(before[new_word], np.bincount(np.cumsum(new_word)[first] - 1), words, at, np.diff(np.append(first, len(after))), place)


COUNTED = "kind string, bucket long, chunk long, contexts binary, pairs binary, counts binary, words binary, blob binary, ids array<string>, stats array<long>"
COUNTED_NAMES = [c.split(" ")[0] for c in COUNTED.split(", ")]


def counted(pairs: DataFrame, deal: Deal) -> DataFrame:
    """Counts of every bucket, and what its pairs add to the scores of the documents of each chunk."""

    def row(kind, **values):
        return {**dict.fromkeys(COUNTED_NAMES), "bucket": 0, "chunk": 0, "kind": kind, **values}

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        if bucket >= ROW_IDS:
            return pd.DataFrame([row("ids", **r) for r in group.to_dict("records")], columns=COUNTED_NAMES)
        blobs = [unpacked(b) for b in group["blob"]]
        before = np.concatenate([np.repeat(b[0], b[1].astype(np.int64)) for b in blobs])
        after = np.concatenate([b[2][b[3].astype(np.int64)] for b in blobs])
        times = np.concatenate([b[4] for b in blobs]).astype(np.int64)
        order = np.lexsort((after, before))
        sorted_before, sorted_after = before[order], after[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (sorted_before[1:] != sorted_before[:-1]) | (sorted_after[1:] != sorted_after[:-1])
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        sorted_before, sorted_after = sorted_before[new], sorted_after[new]
        n_pairs = len(sorted_after)
        place = np.concatenate([b[5] for b in blobs]).astype(np.int64)
        pair = np.repeat(pair, times)
        counts = np.bincount(pair[place % 2 == 1], minlength=n_pairs)
        contexts, context = np.unique(sorted_before, return_inverse=True)
        total = np.bincount(context, counts, len(contexts)).astype(np.int64)
        low = np.stack([np.bincount(context[counts == r], minlength=len(contexts)) for r in range(1, LOW + 1)])
        is_hot, at = deal.find(contexts)
        whole = total.copy()
        whole[is_hot] = deal.count[at[is_hot]]
        is_word = contexts != START
        bare = (low.sum(axis=0) == 0) & (whole > 0)  # nothing discounted; of a frequent word perhaps in another bucket
        with np.errstate(divide="ignore"):
            gain = np.log10(counts) - np.log10(whole + (bare & ~is_hot))[context]
            base = np.where(is_word, np.log10(whole + ADDED), 0)[context]
        gain[counts == 0] = 0
        known = (is_word & (whole > 0))[context]
        words, word = np.unique(sorted_after, return_inverse=True)
        out, start = [], 0
        for number, blob in zip(group["chunk"], blobs, strict=True):
            stop = start + len(blob[5])
            mine, doc = pair[start:stop], place[start:stop] // 2
            start = stop
            size = int(doc.max()) + 1
            here = np.flatnonzero(np.bincount(doc, minlength=size))
            sums = [np.bincount(doc, values[mine], size)[here] for values in (gain, base)]
            tallies = [np.bincount(doc, mask[mine], size)[here].astype(np.int64) for mask in (known, *(counts == r for r in range(1, LOW + 1)))]
            out.append(row("sums", chunk=number, blob=packed(here, *sums, *tallies)))
            new = counts[mine] == 0
            if new.any():
                unseen, doc_new = mine[new], doc[new]
                behind = np.where(whole[context[unseen]] > 0, context[unseen], len(contexts))
                out.append(row("unseen", bucket=bucket, chunk=number, blob=packed(doc_new, behind, word[unseen])))
            late = (bare & is_hot)[context[mine]] & ~new
            if late.any():
                out.append(row("late", chunk=number, blob=packed(contexts[context[mine[late]]], doc[late])))
        seen = counts > 0
        plain = is_word & ~is_hot
        stats = [np.bincount(np.minimum(values, LOW + 2), minlength=LOW + 3)[1 : LOW + 2] for values in (counts, total[plain])]
        out.append(
            row(
                "model",
                bucket=bucket,
                contexts=packed(contexts, total, *low),
                pairs=packed(np.bincount(context[seen], minlength=len(contexts)), word[seen]),
                counts=packed(counts[seen]),
                words=packed(words),
                stats=[*stats[0].tolist(), *stats[1].tolist(), int((total[plain] > 0).sum()), int(total[plain].sum())],
            )
        )
        return pd.DataFrame(out, columns=COUNTED_NAMES)

    tasks = deal.buckets + int(deal.parts.sum())
    return pairs.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(count, COUNTED)


def discounts(of: list[int]) -> np.ndarray:
    """Katz's factor for each count up to LOW, from how many things have count 1 to LOW + 1; 1 beyond.

    Where Good-Turing gives no factor between 0 and 1 (counts of counts with
    holes), half a count is taken off instead.
    """
    out = np.ones(LOW + 2)
    beyond = (LOW + 1) * of[LOW] / of[0] if of[0] else 1.0
    for r in range(1, LOW + 1):
        good = (r + 1) * of[r] / of[r - 1] / r if of[r - 1] else 0.0
        factor = (good - beyond) / (1 - beyond) if beyond != 1 else 0.0
        out[r] = factor if 0 < factor < 1 else 1 - 0.5 / r
    return out


@dataclass
class Model:
    """Everything but the tables: totals, discounts of words and pairs, and weights of frequent words."""

    tokens: int
    vocabulary: int
    documents: int
    word_counts: list[int]
    pair_counts: list[int]
    deal: Deal
    hot_weight: np.ndarray | None = None
    hot_bare: np.ndarray | None = None

    def __post_init__(self):
        self.word_discount, self.pair_discount = discounts(self.word_counts), discounts(self.pair_counts)
        r = np.arange(1, LOW + 1)
        left = float((np.array(self.word_counts[:LOW]) * r * (1 - self.word_discount[1 : LOW + 1])).sum())
        self.divisor = self.tokens + (left == 0)
        self.unknown = (left or 1.0) / self.divisor

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; all words never seen share what is left as one."""
        p = self.word_discount[np.minimum(counts, LOW + 1)] * counts / self.divisor
        return np.where(counts > 0, p, self.unknown)

    def weight(self, total: np.ndarray, low: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Backoff weight of contexts: what the pairs leave, over what the words that do not follow have."""
        r = np.arange(1, LOW + 1)[:, None]
        left = (low * r * (1 - self.pair_discount[1 : LOW + 1, None])).sum(axis=0)
        left = np.where(left == 0, 1, left) / (total + (left == 0))
        return left / np.maximum(1 - seen, self.unknown)


def fitted(tables: dict[str, DataFrame], deal: Deal, documents: int) -> Model:
    stats = {r["pos"]: r["n"] for r in tables["model"].select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    pairs, words = ([int(stats.get(k, 0)) for k in range(a, a + LOW + 1)] for a in (0, LOW + 1))
    others = [int(n) for word, n in zip(deal.hot, deal.count, strict=True) if word != START] + [documents]
    for n in others:
        if 0 < n <= LOW + 1:
            words[n - 1] += 1
    known = int(stats.get(2 * LOW + 2, 0)) + sum(n > 0 for n in others)
    return Model(int(stats.get(2 * LOW + 3, 0)) + sum(others), known, documents, words, pairs, deal)


def word_counts(model_rows: DataFrame, model: Model) -> DataFrame:
    """(bucket, start, blob): counts of the words of every bucket, asked from the buckets that have them as contexts."""
    deal = model.deal

    def ask(batches):
        for batch in batches:
            out = []
            for source, blob in zip(batch["bucket"], batch["words"], strict=True):
                words = unpacked(blob)[0]
                target = deal.plain(words)
                cuts = [0, *(np.flatnonzero(np.diff(target)) + 1).tolist(), len(words)]
                out += [(int(target[i]), source, i, packed(words[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame(out, columns=["target", "bucket", "start", "blob"])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known, total = unpacked(held["contexts"].iloc[0])[:2] if len(held) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        out = []
        for source, start, blob in zip(asked["bucket"], asked["start"], asked["blob"], strict=True):
            words = unpacked(blob)[0]
            counts = np.zeros(len(words), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                counts = np.where(known[at] == words, total[at], 0).astype(np.int64)
            is_hot, at = deal.find(words)
            counts[is_hot] = deal.count[at[is_hot]]
            counts[words == END] = model.documents
            out.append((source, start, packed(counts)))
        return pd.DataFrame(out, columns=["bucket", "start", "blob"])

    asked = model_rows.select("bucket", "words").mapInPandas(ask, "target long, bucket long, start long, blob binary")
    held = model_rows.where(F.col("bucket") < deal.buckets).select(F.col("bucket").alias("target"), "contexts")
    return asked.groupBy("target").cogroup(held.groupBy("target")).applyInPandas(answer, "bucket long, start long, blob binary")


def backed_off(tables: dict[str, DataFrame], answers: DataFrame, model: Model, hot_only: bool = False) -> DataFrame:
    """Backoff weights of the contexts of every bucket, and what unseen pairs add to the scores of a chunk.

    With `hot_only` what a frequent word's buckets tell of its weight: seen
    probability, and how many pairs have each low count.
    """
    deal = model.deal

    def weigh(held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "bucket", "chunk", "blob"]
        contexts, total, *low = unpacked(held["contexts"].iloc[0])
        sizes, word = unpacked(held["pairs"].iloc[0])
        total, low = total.astype(np.int64), np.array(low, dtype=np.int64)
        answers = told[told["start"] >= 0].sort_values("start")
        p = model.word(np.concatenate([unpacked(b)[0] for b in answers["blob"]]).astype(np.int64))
        seen = np.bincount(np.repeat(np.arange(len(contexts)), sizes.astype(np.int64)), p[word.astype(np.int64)], len(contexts))
        bucket = int(held["bucket"].iloc[0])
        if hot_only:
            return pd.DataFrame([("part", bucket, 0, packed(contexts, seen, *low))], columns=columns)
        weight = model.weight(total, low, seen)
        is_hot, at = deal.find(contexts)
        weight[is_hot] = model.hot_weight[at[is_hot]] if is_hot.any() else 0
        out = [("weights", bucket, 0, packed(contexts, total, weight))]
        log_weight = np.append(np.log10(weight), 0)
        for number, blob in zip(told["chunk"][told["start"] < 0], told["blob"][told["start"] < 0], strict=True):
            doc, behind, after = (x.astype(np.int64) for x in unpacked(blob))
            gain = np.bincount(doc, log_weight[behind] + np.log10(p[after]))
            here = np.flatnonzero(np.bincount(doc))
            out.append(("more", bucket, number, packed(here, gain[here])))
        return pd.DataFrame(out, columns=columns)

    told = answers.select("bucket", F.lit(0).cast("long").alias("chunk"), "start", "blob")
    rows = tables["model"].select("bucket", "contexts", "pairs")
    if hot_only:
        rows, told = rows.where(F.col("bucket") >= deal.buckets), told.where(F.col("bucket") >= deal.buckets)
    else:
        told = told.unionByName(tables["unseen"].select("bucket", "chunk", F.lit(-1).cast("long").alias("start"), "blob"))
    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(weigh, "kind string, bucket long, chunk long, blob binary")


def weigh_hot(tables: dict[str, DataFrame], answers: DataFrame, model: Model) -> None:
    """Weights of the frequent words from the parts that their buckets hold, one number a word."""
    deal = model.deal
    seen, low = np.zeros(len(deal.hot)), np.zeros((LOW, len(deal.hot)), dtype=np.int64)
    if len(deal.hot):

        def spread(batches):
            for batch in batches:
                for blob in batch["blob"]:
                    words, p, *counts = unpacked(blob)
                    values = {f"low{r}": c.astype(np.int64) for r, c in enumerate(counts)}
                    yield pd.DataFrame({"word": words.view(np.int64), "seen": p.view(np.float64), **values})

        names = [f"low{r}" for r in range(LOW)]
        parts = backed_off(tables, answers, model, hot_only=True).select("blob").mapInPandas(spread, "word long, seen double, " + ", ".join(f"{n} long" for n in names))
        for r in parts.groupBy("word").agg(F.sum("seen").alias("seen"), *[F.sum(n).alias(n) for n in names]).collect():
            at = int(np.searchsorted(deal.hot, np.array([r["word"]], dtype=np.int64).view(np.uint64)[0]))
            seen[at], low[:, at] = r["seen"], [r[n] for n in names]
    model.hot_weight = model.weight(deal.count, low, seen)
    model.hot_bare = low.sum(axis=0) == 0


def gathered(tables: dict[str, DataFrame], more: DataFrame, model: Model) -> DataFrame:
    """One row per document from all that its chunk's buckets told."""
    log_discount = np.log10(model.pair_discount[1 : LOW + 1])
    each = np.log10(model.tokens + ADDED * (model.vocabulary + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add(group: pd.DataFrame) -> pd.DataFrame:
        blobs = {kind: [unpacked(b) for b in part] for kind, part in group.groupby("kind")["blob"]}
        lengths, held_out = blobs["ids"][0]
        score, base, known = np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
        for here, gain, plain, told, *low in blobs.get("sums", []):
            here = here.astype(np.int64)
            score[here] += gain.view(np.float64) + log_discount @ np.array(low, dtype=np.float64)
            base[here] += plain.view(np.float64)
            known[here] += told.astype(np.int64)
        for here, gain in blobs.get("more", []):
            score[here.astype(np.int64)] += gain.view(np.float64)
        for words, doc in blobs.get("late", []):
            at = np.searchsorted(model.deal.hot, words)
            lost = np.where(model.hot_bare[at], np.log10((model.deal.count[at] + 1) / model.deal.count[at]), 0)
            score -= np.bincount(doc.astype(np.int64), lost, len(score))
        lengths = lengths.astype(np.int64)
        ids = group.loc[group["kind"] == "ids", "ids"].iloc[0]
        values = (ids, held_out.astype(bool), lengths, known + (model.documents > 0), model.tokens, base + np.log10(model.documents + ADDED) - lengths * each, score)
        return pd.DataFrame(dict(zip(names, values, strict=True)))

    none = F.lit(None).cast("array<string>").alias("ids")
    rows = more.select("kind", "chunk", "blob", none)
    for kind in ("sums", "late", "ids"):
        rows = rows.unionByName(tables[kind].select(F.lit(kind).alias("kind"), "chunk", "blob", "ids" if kind == "ids" else none))
    # Ids travel as text, since pandas turns whole numbers beside nulls into floats.
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").applyInPandas(add, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def by_kind(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """Write rows into one partition per kind; the tables of a model are partitions of these."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return {kind: kept.where(F.col("kind") == kind) for kind in ("model", "sums", "unseen", "late", "ids", "weights", "more")}


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """log10 probability of every whole text under a Katz model learnt from the texts that are not held out.

    p(w | v) = d(c) c(v, w) / c(v) for pairs seen, else weight(v) p(w); d are
    Good-Turing discounts of counts up to 5, and weight(v) makes p(. | v) sum
    to one over all words and one unknown word. A context of which no count is
    discounted gives up one count in c(v) + 1. p(w) is discounted alike, and
    what is left is the unknown word's. Behind a word never seen p(w) counts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Null and empty texts are the end token alone. Rows with a null id
    are neither learnt from nor held out. Repeated rows count each; without
    rows to learn from all words are unknown, with score 0. Other columns are
    not looked at.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learn"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    )
    deal, documents = plan(rows, chunk_tokens, bucket_tokens)
    tables = by_kind(counted(dealt(rows, deal, chunk_tokens), deal), "counted")
    release(docs)
    model = fitted(tables, deal, documents)
    answers = stored(word_counts(tables["model"], model), "answers")
    weigh_hot(tables, answers, model)
    weighed = by_kind(backed_off(tables, answers, model), "weighed")
    release(docs)
    return gathered(tables, weighed["more"].select("kind", "chunk", "blob"), model)
