"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE_SIZE = 400
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
CHUNK_CHARS = 1_000_000
CODE_BITS = 21  # a code point has at most 21 bits, so three fit into 63


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all letters, pairs and triples in the words of a text, lower case, words padded with one blank.

    A code holds the code points side by side, so the three lengths never mix.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = letter_table()[points] if len(points) else np.zeros(0, dtype=bool)
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    after = np.concatenate(([False], letter[:-1]))
    line = np.where(letter, points, 32)[letter | after]
    line = np.concatenate(([32], line, [32] if line[-1] != 32 else []))
    line = line.astype(np.int64)
    pairs = line[:-1] << CODE_BITS | line[1:]
    triples = (pairs[:-1] << CODE_BITS | line[2:])[line[1:-1] != 32]
    return np.concatenate((line[line != 32], pairs, triples))


def learn_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) for every n-gram of every row; each task adds up its own before anything is shuffled."""

    def merge(held, codes, counts):
        if held is not None:
            codes, counts = np.concatenate((held[0], codes)), np.concatenate((held[1], counts))
        found, at = np.unique(codes, return_inverse=True)
        return found, np.bincount(at, counts, len(found)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                waiting, size = [], 0
                for text in [*texts, None]:
                    if text is not None:
                        # A very long text goes in parts cut at blanks' places; n-grams across a cut are those of a word break.
                        for at in range(0, len(text), CHUNK_CHARS):
                            waiting.append(grams(text[at : at + CHUNK_CHARS]))
                            size += len(waiting[-1])
                            if size > 3 * CHUNK_CHARS:
                                held[lang] = merge(held.get(lang), *np.unique(np.concatenate(waiting), return_counts=True))
                                waiting, size = [], 0
                    elif size:
                        held[lang] = merge(held.get(lang), *np.unique(np.concatenate(waiting), return_counts=True))
                if lang in held and len(held[lang][0]) > 500_000:
                    yield pd.DataFrame({"lang": lang, "gram": held[lang][0], "n": held[lang][1]})
                    del held[lang]
        for lang, (codes, counts) in held.items():
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})

    return rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, place): the `size` most frequent n-grams of each language over all given texts.

    Rows with a null lang or text teach nothing. Equal counts are ordered by code.
    """
    counts = learn_counts(docs.where("lang is not null and text is not null"))
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")


class Profiles:
    """All profiles side by side: one row per n-gram that any of them holds, one column per language."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.languages = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.languages)), np.nan)
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), self.languages.index(r["lang"])] = r["place"]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language with the least out-of-place distance, and its share of the nearness to all languages.

        An n-gram that a profile lacks counts as `size` places. Of languages
        equally near the first by name is taken. No letter: ("und", 0).
        """
        codes = grams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        found, counts = np.unique(codes, return_counts=True)
        top = np.lexsort((found, -counts))[: self.size]
        at = np.searchsorted(self.grams, found[top])
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != found[top])] = len(self.grams)
        away = np.abs(self.places[at] - np.arange(1, len(top) + 1)[:, None])
        distance = np.where(np.isnan(away), self.size, np.minimum(away, self.size)).sum(axis=0)
        near = self.size * len(top) - distance
        best = int(np.argmax(near))
        return self.languages[best], float(near[best] / near.sum()) if near.sum() > 0 else 1.0 / len(self.languages)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def identify(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Predict the language of every text with profiles learned from the rows that are not held out.

    Profiles hold `size` rows for each language, which is all that the driver
    sees. Returns doc_id, held_out, lang_pred, score. Null texts and texts
    without a letter are `und` with score 0; so is everything when no row
    teaches a language. Rows with a null id are neither learned from nor held
    out. Repeated rows are predicted each; other columns are not looked at.
    """
    profiles = Profiles(learn_profiles(docs.where(fold() != HELD_OUT), size).collect(), size)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [profiles.nearest(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "held_out": batch["held_out"].astype(bool),
                "lang_pred": [lang for lang, _ in found],
                "score": [score for _, score in found],
            })

    # Ids travel as text, since pandas turns whole numbers beside nulls into floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
