import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from stayline.llm import katz

SCHEMA = "doc_id long, text string, score int, bucket string, blob string"
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def factor(r, of):
    if r > katz.LOW:
        return 1.0
    try:
        beyond = (katz.LOW + 1) * of[katz.LOW + 1] / of[1]
        d = ((r + 1) * of[r + 1] / of[r] / r - beyond) / (1 - beyond)
    except ZeroDivisionError:
        d = 0
    return d if 0 < d < 1 else 1 - 0.5 / r


class Plain:
    """The model as dictionaries, evaluated by its definition."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            line = [None, *words(text), "<end>"]
            self.one.update(line[1:])
            for v, w in zip(line, line[1:]):
                self.two[v][w] += 1
        self.n = sum(self.one.values())
        self.of_one, self.of_two = Counter(self.one.values()), Counter(c for after in self.two.values() for c in after.values())
        left = sum(c * (1 - factor(c, self.of_one)) for c in self.one.values())
        self.divisor = self.n + (left == 0)
        self.unknown = (left or 1) / self.divisor

    def p_one(self, w):
        c = self.one.get(w, 0)
        return factor(c, self.of_one) * c / self.divisor if c else self.unknown

    def p(self, w, v):
        after = self.two.get(v)
        if not after:
            return self.p_one(w)
        left = sum(c * (1 - factor(c, self.of_two)) for c in after.values())
        total = sum(after.values()) + (left == 0)
        if w in after:
            return factor(after[w], self.of_two) * after[w] / total
        return (left or 1) / total / (1 - sum(self.p_one(x) for x in after)) * self.p_one(w)

    def score(self, text):
        line = [None, *words(text), "<end>"]
        base = sum(math.log10((self.one.get(w, 0) + 0.1) / (self.n + 0.1 * (len(self.one) + 1))) for w in line[1:])
        known = sum(w in self.one for w in line[1:])
        return len(line) - 1, known, self.n, base, sum(math.log10(self.p(w, v)) for v, w in zip(line, line[1:]))


def check(out, rows):
    assert out.columns == NAMES
    folds = [None if r[0] is None else crc32(str(r[0]).encode()) % 10 for r in rows]
    model = Plain([r[1] for r, f in zip(rows, folds) if f])
    want = sorted([(r[0], f == 0, *model.score(r[1])) for r, f in zip(rows, folds)], key=str)
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        line = [vocabulary[min(int(rng.paretovariate(0.8)) - 1, 59)] for _ in range(rng.randint(0, 25))]
        out.append(" \t\n"[rng.randint(0, 2)].join(line))
    return [*out, None, "", "Été ÉTÉ ÀB aB", "THE the The", "new words never seen", "x" * 300, "of the " * 40, "of the " * 40]


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [(katz.CHUNK_TOKENS, katz.BUCKET_TOKENS), (150, 100), (60, 7)])
def test_against_dictionaries(spark, sizes):
    """The small sizes make several chunks, buckets and frequent words that are dealt over buckets."""
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))]
    rows += [(None, "unlearnt words w1 w2"), (7, rows[7][1]), (7, rows[7][1])]
    model = check(katz.score(given(spark, rows).repartition(3), *sizes), rows)
    for v in [*list(model.two)[:20], "never"]:
        assert sum(model.p(w, v) for w in [*model.one, "unknown"]) == pytest.approx(1)


def test_context_without_low_counts(spark):
    """Few words, each pair often: nothing is discounted, one count is given up."""
    rows = [(i, "a b a b a b" if i % 3 else "a c a c") for i in range(60)] + [(i, "c b z") for i in range(60, 100) if crc32(str(i).encode()) % 10 == 0]
    for sizes in ((katz.CHUNK_TOKENS, katz.BUCKET_TOKENS), (40, 20)):
        check(katz.score(given(spark, rows).repartition(2), *sizes), rows)


def test_nothing_to_learn_from(spark):
    rows = [(None, "some text"), (None, None)] + [(i, "held out") for i in range(60) if crc32(str(i).encode()) % 10 == 0]
    out = katz.score(given(spark, rows)).collect()
    assert len(out) == len(rows) and {(r.n_known, r.train_tokens, r.score, r.base_score) for r in out} == {(0, 0, 0.0, 0.0)}
    assert katz.score(given(spark, rows).limit(0)).count() == 0


def test_long_text_in_parts(monkeypatch):
    text = "alpha Beta  gamma\n" * 50
    whole = next(katz.text_hashes([text]))
    monkeypatch.setattr(katz.shingles, "CHUNK_BYTES", 64)
    assert np.array_equal(np.concatenate(list(katz.text_hashes([text]))), whole)
    assert len(whole) == 150 and len(set(whole.tolist())) == 3


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = katz.score(docs)
    check(out, rows)
    held = out.where("held_out and n_known > 100").collect()
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)
