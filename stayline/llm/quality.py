"""A quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
CHUNK, STEP = 1024, 960  # bytes of a chunk and from one chunk to the next
WIDTH, STRIDE, FILTERS, HIDDEN = 6, 2, 16, 16
TRAIN_ROWS = 2500  # of each label, those with the smallest hash of their id
TRAIN_CHUNKS = 8  # of each training text, drawn at random
EPOCHS, BATCH, RATE = 16, 64, 0.01
CROP_SHARE, CROP_BYTES = 0.35, (8, 400)  # training texts seen as a short crop in an epoch, and the length of crops


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the text's UTF-8 bytes, filled up with zeros, and how many bytes of each are text.

    Chunks overlap by CHUNK - STEP bytes and together cover every byte.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    starts = np.arange(0, max(len(data) - (CHUNK - STEP), 1), STEP)
    padded = np.zeros(int(starts[-1]) + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    cut = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]
    return cut, np.minimum(len(data) - starts, CHUNK)


def places(sizes: np.ndarray) -> np.ndarray:
    """Which filter positions lie inside the text; the first one always counts."""
    first = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
    return (first[None, :] + WIDTH <= sizes[:, None]) | (first == 0)[None, :]


class Network:
    """Filters over bytes, maximum over each chunk, mean and maximum over chunks, one hidden layer, one probability."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.values = {
            "table": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, dtype=np.float32),
            "mix": rng.normal(0, 0.25, (2 * FILTERS + 1, HIDDEN)).astype(np.float32),
            "mix_bias": np.zeros(HIDDEN, dtype=np.float32),
            "out": rng.normal(0, 0.25, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, dtype=np.float32),
        }
        self.constant: float | None = None
        self.pairs: np.ndarray | None = None

    def __getstate__(self):
        return {"values": self.values, "constant": self.constant, "pairs": None}

    def respond(self, cut: np.ndarray, sizes: np.ndarray, where: bool = False):
        """Largest response of every filter in every chunk, and the position it has.

        Two neighbouring bytes are one 16-bit index into a table of summed
        filter weights, so a position costs three look-ups.
        """
        if self.pairs is None:
            t = self.values["table"]
            self.pairs = np.stack([(t[k + 1][:, None, :] + t[k][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])
        words = np.ascontiguousarray(cut).view("<u2")
        n = (CHUNK - WIDTH) // STRIDE + 1
        best = np.empty((len(cut), FILTERS), dtype=np.float32)
        at = np.empty((len(cut), FILTERS), dtype=np.int64) if where else None
        for i in range(0, len(cut), 32):
            part = words[i : i + 32]
            heat = self.pairs[0].take(part[:, :n], axis=0)
            for k in range(1, WIDTH // 2):
                heat += self.pairs[k].take(part[:, k : k + n], axis=0)
            if (sizes[i : i + 32] < CHUNK).any():
                heat[~places(sizes[i : i + 32])] = -np.inf
            best[i : i + 32] = heat.max(axis=1)
            if where:
                at[i : i + 32] = heat.argmax(axis=1)
        return best, at

    def pool(self, best: np.ndarray, sizes: np.ndarray, first: np.ndarray):
        """Mean and maximum over the chunks of each text, and the logarithm of its largest chunk's bytes.

        `first` is the first chunk of each text. The length tells a filter
        that is silent in a short text from one that is silent in a long one.
        """
        live = np.maximum(best + self.values["bias"], 0)
        count = np.diff(np.append(first, len(best)))[:, None]
        long = np.log2(1 + np.maximum.reduceat(sizes, first))[:, None] / 10
        return live, np.hstack((np.add.reduceat(live, first, axis=0) / count, np.maximum.reduceat(live, first, axis=0), long)), count

    def top(self, features: np.ndarray):
        v = self.values
        hidden = np.maximum(features @ v["mix"] + v["mix_bias"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ v["out"] + v["out_bias"][0], -30, 30)))

    def score(self, texts: list) -> np.ndarray:
        """Probability of label 1 for each text, over all its chunks."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        scores, waiting, held = [], [], 0

        def flush():
            cut, sizes = (np.concatenate(x) for x in zip(*waiting, strict=True))
            best, _ = self.respond(cut, sizes)
            first = np.cumsum([0, *(len(c) for c, _ in waiting[:-1])])
            scores.append(self.top(self.pool(best, sizes, first)[1])[1])

        for text in texts:
            waiting.append(chunks(text))
            held += len(waiting[-1][0])
            if held > 2048:
                flush()
                waiting, held = [], 0
        if waiting:
            flush()
        return np.concatenate(scores).astype(float) if scores else np.zeros(0)

    def gradients(self, cut, sizes, first, labels, weights):
        v = self.values
        best, at = self.respond(cut, sizes, where=True)
        live, features, count = self.pool(best, sizes, first)
        hidden, p = self.top(features)
        slope = ((p - labels) * weights / len(labels)).astype(np.float32)
        back = slope[:, None] * v["out"][None, :] * (hidden > 0)
        feature_slope = back @ v["mix"].T
        owner = np.repeat(np.arange(len(first)), count[:, 0])
        is_most = (live == features[owner, FILTERS : 2 * FILTERS]).astype(np.float32)
        is_most /= np.add.reduceat(is_most, first, axis=0)[owner]  # equal chunks share the slope
        chunk_slope = feature_slope[owner, :FILTERS] / count[owner] + feature_slope[owner, FILTERS : 2 * FILTERS] * is_most
        chunk_slope *= live > 0
        table = np.zeros_like(v["table"])
        filters = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            byte = np.take_along_axis(cut, at * STRIDE + k, axis=1).astype(np.int64)
            table[k] = np.bincount((byte * FILTERS + filters).ravel(), chunk_slope.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return {
            "table": table,
            "bias": chunk_slope.sum(axis=0),
            "mix": features.T @ back,
            "mix_bias": back.sum(axis=0),
            "out": hidden.T @ slope,
            "out_bias": slope.sum(keepdims=True),
        }


def crop(sample: tuple, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A short stretch of one chunk, as a text of its own."""
    cut, sizes, _ = sample
    at = rng.integers(len(cut))
    start = int(rng.integers(max(int(sizes[at]) - CROP_BYTES[0], 1)))
    text = cut[at, start : min(start + int(rng.integers(*CROP_BYTES)), max(int(sizes[at]), 0))]
    out = np.zeros((1, CHUNK), dtype=np.uint8)
    out[0, : len(text)] = text
    return out, np.array([len(text)])


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Network:
    """Fit by Adam on (chunks, sizes, label); both labels weigh the same in all.

    Some texts are seen as short crops, so that short ones are judged fairly.
    Without both labels the network is a constant: the share of label 1, or a
    half when there is no sample at all.
    """
    network, rng = Network(seed), np.random.default_rng(seed)
    labels = np.array([s[2] for s in samples], dtype=np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        network.constant = float(labels[0]) if len(labels) else 0.5
        return network
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first_moment = {k: np.zeros_like(x) for k, x in network.values.items()}
    second_moment = {k: np.zeros_like(x) for k, x in network.values.items()}
    step = 0
    steps = EPOCHS * -(-len(samples) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            seen = [crop(samples[r], rng) if rng.random() < CROP_SHARE else samples[r][:2] for r in rows]
            cut, sizes = (np.concatenate([x[j] for x in seen]) for j in (0, 1))
            first = np.cumsum([0, *(len(x[0]) for x in seen[:-1])])
            slopes = network.gradients(cut, sizes, first, labels[rows], weights[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in slopes.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                move = first_moment[k] / (1 - 0.9**step) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                network.values[k] = (network.values[k] - rate * move).astype(np.float32)
            network.pairs = None
    return network


def fold(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most `rows` labelled texts of each label outside the held-out fold, TRAIN_CHUNKS chunks of each.

    An id with both labels teaches nothing; an id with several texts teaches
    the smallest one. The ids are picked by hash over all labels, so the
    sample is the same in every run and at most 2 * `rows` texts of
    TRAIN_CHUNKS * CHUNK bytes reach the driver.
    """
    known = labels.where("quality in (0, 1)").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.withColumn("rank", rank).where(F.col("rank") <= rows).select(F.col("doc_id").alias("label_id"), "label")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                cut, sizes = chunks(text)
                some = np.sort(np.random.default_rng(abs(int(doc_id))).permutation(len(cut))[:TRAIN_CHUNKS])
                digest = hash_text(text)
                out.append((int(doc_id), digest, int(label), np.ascontiguousarray(cut[some]).tobytes(), sizes[some].astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "digest", "label", "cut", "sizes"])

    # The picked ids are bounded by 2 * `rows`, so sending them to all executors is too.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    drawn = joined.mapInPandas(draw, "doc_id long, digest string, label int, cut binary, sizes binary")
    best = drawn.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "cut", "sizes")).alias("s")).orderBy("doc_id").select("s.*")
    return [(np.frombuffer(r["cut"], dtype=np.uint8).reshape(-1, CHUNK), np.frombuffer(r["sizes"], dtype="<i8"), r["label"]) for r in best.toLocalIterator()]


def hash_text(text: str | None) -> str:
    import hashlib

    return hashlib.sha1((text or "").encode("utf-8", "replace")).hexdigest()


def score(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text, null texts as empty ones."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = network.score(list(batch["text"]))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "held_out": batch["held_out"].astype(bool),
                "score": scores,
                "predicted": (scores >= threshold).astype("int32"),
            })

    # Ids travel as text, since pandas turns whole numbers beside nulls into floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(rate, "doc_id string, held_out boolean, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast("long"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labels outside the held-out fold, then score every text.

    Rows with a null id are scored but not held out and teach nothing. Null
    labels teach nothing; without labels every score is 0.5. Repeated rows are
    scored each; other columns of either table are not looked at.
    """
    return score(docs, train(training_sample(docs, labels, rows)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns kept, in one pass over the table."""
    network = train(training_sample(docs, labels, rows))

    @F.pandas_udf("double")
    def rated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(network.score(list(part)))

    return docs.where(rated(F.col("text")) >= threshold)
