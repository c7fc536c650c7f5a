import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stayline.llm import packing


def check_layout(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_against_tokenizer(spark):
    texts = ["", None, "a", "word " * 5000, "<|endoftext|> inside", "ünï 漢字 \n\n  x", "same text", "same text", "x" * 30_000]
    texts += [f"document {i} " * (i % 97) for i in range(400)]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "no id", 1, "s"), (3, "again", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, task int, slot string").repartition(5)
    out = packing.pack(df, with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    total = sum(r.length for r in out)
    assert check_layout(out, 2048) <= -(-total // 2048) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table_near_bound(spark, sf_dir):
    out = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert check_layout(out, 2048) <= -(-sum(r.length for r in out) // 2048) * 1.02 + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 60), max_size=300))
def test_plan_uses_each_piece_once(size, lengths):
    histogram = np.bincount([x for x in lengths if x <= size], minlength=size + 1)
    plan = packing.packing_plan(histogram, size)
    used = np.zeros(size + 1, dtype=int)
    for pattern, count in plan:
        assert count > 0 and sum(pattern) <= size
        for x in pattern:
            used[x] += count
    assert (used == histogram).all()


def test_fit_takes_most_of_a_rich_histogram():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(rng.geometric(0.01, 50_000), 256), minlength=257)
    sequences = sum(n for _, n in packing.packing_plan(histogram, 256))
    bound = -(-int((np.arange(257) * histogram).sum()) // 256)
    assert sequences <= bound * 1.005
    fitted = sum(n * sum(p) for p, n in packing.fit_patterns(histogram, 256))
    assert fitted > 0.6 * (np.arange(257) * histogram).sum()


@pytest.mark.parametrize("count", [0, 1])
def test_tiny_histograms(count):
    assert sum(n for _, n in packing.packing_plan(np.array([0, count]), 1)) == count
