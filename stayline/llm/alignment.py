"""Alignment of two tokenizers over a corpus, each distinct text tokenised once."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import stored

KNOWN_PAIRS = 1 << 20  # bound of the list of frequent id pairs that every task holds
HOT_SHARE = 1000  # a text that makes up one row in so many is joined by broadcast, so at most this many texts are
SLICE_CHARS = 1_000_000  # of a long text that are looked at together
CACHE_WORDS, CACHE_CHARS = 400_000, 40_000_000
SPACE = "▁"
# A blank after one of these may lie inside a token; after any other character a token ends.
UNSURE = [chr(c) for c in (*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x2581, 0x3000, 0xFEFF)]
CUT = re.compile("(?<=[^" + "".join(map(re.escape, UNSURE)) + "]) ")
UNSURE_ENDS = frozenset(["", *UNSURE])
_tools: dict = {}


class Tokenizers:
    """Both tokenizers, and the bytes and written ids of all their tokens."""

    def __init__(self, ranks_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_rank = {rank: token for token, rank in ranks.items()}
        self.a_bytes = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([[f"{i}{end}" for i in range(len(side))] for end in ends], dtype=object) for side, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.blank = self.b.piece_to_id(SPACE)
        # No piece goes on behind a word's end, so words can be taken one by one.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def encode(self, text: str, want: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of one blank and the text; None where the bytes of the tokens are not those wanted."""
        a = self.a.encode_ordinary(" " + text)
        # The second tokenizer puts the blank there by itself, but not before nothing.
        b = self.b.encode(text, num_threads=1) if text else [self.blank]
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def align(self, parts: list[str]) -> list[tuple]:
        """For runs of parts that have tokens: (parts, facts, links, groups); facts and groups have a row each, groups end in ';'.

        Parts are encoded side by side, since tokens end where parts do. Links
        are first id * size of the second vocabulary + second id, in order of
        the parts. Parts whose bytes do not come back are left out.
        """
        lengths = np.array([len(p.encode("utf-8", "replace")) + 1 for p in parts], dtype=np.int64)
        text = " ".join(parts)
        ids = self.encode(text, (" " + text).encode("utf-8", "replace"))
        if ids is None:
            if len(parts) == 1:
                return []
            half = len(parts) // 2
            return self.align(parts[:half]) + self.align(parts[half:])
        a, b = ids
        stops, a_stops, b_stops = np.cumsum(lengths), np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        cuts = np.intersect1d(a_stops, b_stops, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_stops), np.searchsorted(cuts, b_stops)
        part = np.searchsorted(stops, cuts)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        a_before, b_before = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        times = n_b[a_group]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        links = np.repeat(a, times) * len(self.b_bytes) + b[np.repeat(b_before[a_group], times) + place]
        facts = np.stack([np.bincount(part, w, len(parts)) for w in (n_a, n_b, np.ones(len(cuts)), n_a * n_b)], axis=1).astype(np.int64)
        line = np.empty(len(a) + len(b), dtype=object)
        line[np.arange(len(a)) + b_before[a_group]] = self.a_text[np.diff(a_group, append=len(cuts)), a]
        line[np.arange(len(b)) + a_before[b_group] + n_a[b_group]] = self.b_text[np.diff(b_group, append=len(cuts)), b]
        line, ends = line.tolist(), np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        groups = ["".join(line[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return [(parts, facts, links, groups)]


def tokenizers(ranks_path: str, piece_path: str) -> Tokenizers:
    if (ranks_path, piece_path) not in _tools:
        _tools[ranks_path, piece_path] = Tokenizers(ranks_path, piece_path)
    return _tools[ranks_path, piece_path]


def grown(values: np.ndarray, size: int) -> np.ndarray:
    return values if len(values) >= size else np.concatenate((values, np.zeros((max(size, 2 * len(values)) - len(values), *values.shape[1:]), values.dtype)))


class Words:
    """Aligned parts of texts, kept while there is room."""

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((1024, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.first = np.zeros(1024, dtype=np.int64)  # place of a part's first link
        self.links = np.zeros(4096, dtype=np.int64)
        self.used = self.chars = 0

    def slices(self, text: str) -> Iterator[list[str]]:
        """The words of a text: no token of either tokenizer reaches from one into the next."""
        if not self.tools.by_word:
            yield [text]
            return
        start = 0
        while start <= len(text):
            found = CUT.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
            part = text[start : found.start()] if found else text[start:]
            parts = part.split(" ")
            yield parts if UNSURE_ENDS.isdisjoint([p[-1:] for p in parts[:-1]]) else CUT.split(part)
            if not found:
                return
            start = found.end()

    def learn(self, parts: list[str]):
        # Only the last part of a text may end where a token may go on; such parts are taken alone.
        self.at.update(dict.fromkeys(parts, -1))
        self.chars += sum(map(len, parts))
        sure = [p for p in parts if p[-1:] not in UNSURE_ENDS]
        found = self.tools.align(sure) if sure else []
        for p in parts:
            if p[-1:] in UNSURE_ENDS:
                found += self.tools.align([p])
        for kept, facts, links, groups in found:
            row = len(self.groups)
            self.at.update(zip(kept, range(row, row + len(kept)), strict=True))
            self.groups += groups
            self.facts, self.first = grown(self.facts, row + len(kept)), grown(self.first, row + len(kept))
            self.links = grown(self.links, self.used + len(links))
            self.facts[row : row + len(kept)] = facts
            self.first[row : row + len(kept)] = self.used + np.cumsum(facts[:, 3]) - facts[:, 3]
            self.links[self.used : self.used + len(links)] = links
            self.used += len(links)

    def texts(self, texts) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Per text: sums of facts, digest of its groups, its distinct links and how often each; None without tokens."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(text)
            held += len(text)
            if held > SLICE_CHARS // 4:
                yield from self.together(waiting)
                waiting, held = [], 0
        yield from self.together(waiting)

    def together(self, texts: list[str]):
        if len(self.groups) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        # New words of many texts are learnt in one go; a long text goes slice by slice.
        cut = [list(self.slices(text)) if len(text) <= SLICE_CHARS else self.slices(text) for text in texts]
        self.know([p for slices in cut if isinstance(slices, list) for parts in slices for p in parts])
        yield from map(self.whole, cut)

    def know(self, parts: list[str]):
        new = set(parts).difference(self.at)
        if new:
            self.learn(list(new))

    def whole(self, slices: Iterable[list[str]]):
        digest, facts, links, held = hashlib.sha256(), np.zeros(4, dtype=np.int64), [], None
        for parts in slices:
            if not isinstance(slices, list):
                self.know(parts)
            rows = list(map(self.at.__getitem__, parts))
            if -1 in rows:
                return None
            if held:
                digest.update(held)
            held = "".join(map(self.groups.__getitem__, rows)).encode()
            rows = np.array(rows, dtype=np.int64)
            mine = self.facts[rows]
            facts += mine.sum(axis=0)
            n = mine[:, 3]
            links.append(np.unique(self.links[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())], return_counts=True))
        digest.update(held[:-1])
        return facts, digest.hexdigest(), *(links[0] if len(links) == 1 else added(links))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several lists of distinct keys, added up."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def packed(pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted pairs in the fewest bytes that hold them, and their times as bytes; more than 255 times go on in a next entry."""
    entries = (times + 254) // 255
    pairs, last = np.repeat(pairs, entries), np.cumsum(entries) - 1
    counts = np.full(len(pairs), 255, dtype=np.uint8)
    counts[last] = times - 255 * (entries - 1)
    wide = np.uint32 if len(pairs) == 0 or pairs[-1] < 1 << 32 else np.uint64
    return pairs.astype(wide).tobytes(), counts.tobytes()


def unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(times, dtype=np.uint8).astype(np.int64)
    wide = np.uint32 if len(pairs) == 4 * len(counts) else np.uint64
    return np.frombuffer(pairs, dtype=wide).astype(np.int64), counts


SIZES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(texts: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """Every text with tokens: key, n, its sizes, the digest of its groups, and its linked pairs with how often each."""
    names = ["key", "n", *SIZES, "groups_sha256", "pairs", "times"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(tokenizers(ranks_path, piece_path))
        for batch in batches:
            rows = []
            for key, n, found in zip(batch["key"], batch["n"], words.texts(batch["text"]), strict=True):
                if found is not None:
                    rows.append((key, n, *found[0].tolist(), found[1], *packed(*found[2:])))
            yield pd.DataFrame(rows, columns=names)

    schema = "key binary, n long, " + ", ".join(f"{n} long" for n in SIZES) + ", groups_sha256 string, pairs binary, times binary"
    return texts.select("key", "n", "text").mapInPandas(look, schema)


def count_pairs(found: DataFrame) -> DataFrame:
    """(pair, n): in how many documents an id pair is linked. Tasks add up their own texts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for n, pairs, times in zip(batch["n"], batch["pairs"], batch["times"], strict=True):
                mine = unpacked(pairs, times)[0]
                mine = mine[np.diff(mine, prepend=-1) > 0]
                parts.append((mine, np.full(len(mine), n, dtype=np.int64)))
                held += len(mine)
                if held > 3_000_000:
                    parts = [added(parts)]
                    held = len(parts[0][0])
                    if held > 2_000_000:
                        yield pd.DataFrame({"pair": parts[0][0], "n": parts[0][1]})
                        parts, held = [], 0
        if parts:
            total = added(parts)
            yield pd.DataFrame({"pair": total[0], "n": total[1]})

    told = found.select("n", "pairs", "times").mapInPandas(count, "pair long, n long")
    return told.groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_pairs(counts: DataFrame, best: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `most` of the most frequent pairs, sorted, their counts, and whether a count is the highest of the pair's first id."""
    by_size = {r["b"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()}
    least, total = 63, 0
    for b in sorted(by_size, reverse=True):
        total += by_size[b]
        if total > most:
            break
        least = b
    rows = counts.where(F.col("n") >= F.lit(float(2**least))).join(F.broadcast(best), "id").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")).toPandas()
    pairs = rows["pair"].to_numpy(dtype=np.int64)
    order = np.argsort(pairs)
    return pairs[order], rows["n"].to_numpy(dtype=np.int64)[order], rows["is_best"].to_numpy(dtype=bool)[order]


def measure(found: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """One row of sums per text over links whose pair is in the list, and rows (key, pair, times) of the others."""
    known_pairs, known_counts, known_best = known
    names = ["key", "n_best", "count_sum", "pair", "times"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, rare = [], []
            for key, pairs, times in zip(batch["key"], batch["pairs"], batch["times"], strict=True):
                pairs, times = unpacked(pairs, times)
                at = np.searchsorted(known_pairs, pairs)
                at[at == len(known_pairs)] = 0
                hit = known_pairs[at] == pairs if len(known_pairs) else np.zeros(len(pairs), dtype=bool)
                at, n = at[hit], times[hit]
                rows.append((key, int(n[known_best[at]].sum()), int((known_counts[at] * n).sum()), None, 0))
                rare.extend((key, 0, 0, str(p), t) for p, t in zip(pairs[~hit].tolist(), times[~hit].tolist(), strict=True))
                if len(rare) > 200_000:
                    yield pd.DataFrame(rare, columns=names)
                    rare = []
            if rows or rare:
                yield pd.DataFrame([*rows, *rare], columns=names)

    # Pairs travel as text, since pandas turns whole numbers beside nulls into floats.
    rows = found.select("key", "pairs", "times").mapInPandas(look, "key binary, n_best long, count_sum long, pair string, times long")
    return rows.withColumn("pair", F.col("pair").cast("long"))


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, ranks_path: str | None = None, piece_path: str | None = None, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """Token counts, alignment groups and linked id pairs of every document under two tokenizers.

    Rows are shuffled by their full text, and each distinct text is tokenised
    and aligned once, with the number of its rows as weight of its id pairs.
    Groups are cut where tokens of both end. The `known_pairs` most frequent
    pairs at most are a list in every task; links of all other pairs are
    joined with the table of counts, so the result is the same for any bound.
    Measures come back to the rows by a digest of the text; a text that is one
    row in a thousand or more is joined by broadcast (at most a thousand are).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Null and empty texts, and those that a tokenizer does not
    give back byte by byte, have zeros and ''. Repeated rows and rows with a
    null id are documents of their own; other columns are not looked at.
    """
    import public_tokenizers

    files = (ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), piece_path or public_tokenizers.path("piece_bpe_32k.model"))
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    ids = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")), "ids")
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    found = stored(aligned(texts.withColumn("key", key), *files), "aligned")
    pairs = stored(count_pairs(found).withColumn("id", F.expr(f"pair div {len(tokenizers(*files).b_bytes)}")), "pairs")
    best = pairs.groupBy("id").agg(F.max("n").alias("best"))  # one row per id of the vocabulary
    sums = stored(measure(found, frequent_pairs(pairs, best, known_pairs)), "sums")

    rare = sums.where("pair is not null").select("key", "pair", "times").join(pairs, "pair").join(F.broadcast(best), "id")
    rare = rare.select("key", F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums = sums.where("pair is null").select("key", "n_best", "count_sum").unionByName(rare)
    sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = found.select("key", "n", *SIZES, "groups_sha256").join(sums, "key")

    limit = max(ids.count() // HOT_SHARE, 1)
    many = found.where(F.col("n") > limit).select(F.col("key").alias("hot_key"))
    flagged = ids.join(F.broadcast(many), F.col("key") == F.col("hot_key"), "left")
    often = flagged.where("hot_key is not null").drop("hot_key").join(F.broadcast(whole.where(F.col("n") > limit)), "key", "left")
    seldom = flagged.where("hot_key is null").drop("hot_key").join(whole, "key", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in MEASURES]
    return often.unionByName(seldom).select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
