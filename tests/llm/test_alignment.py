import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stayline.llm import alignment

SCHEMA = "doc_id long, text string, n_a long, key string, pair long"
MEASURES = alignment.MEASURES

TEXTS = [
    "The quick brown fox, jumps over 1234567 lazy dogs!",
    "  leading and  double   spaces\t\ttabs \n\n newlines \r\n end ",
    "café naïve 漢字かな \U0001f600\U0001f468‍\U0001f469  nbsp 　wide \x1c \x85 x",
    "contains ▁ the mark",
    "a<|endoftext|>b <s> </s> <unk> <0x41> it's we'll 'S",
    " ",
    "a",
    "a ",
    "x\n \n y \x0b z  u​ v",
    "zz\x00 nul \x7f del",
    "of the of the of the",
]


def byte_level():
    """The alphabet of byte-level tokens: printable bytes stand for themselves, the others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(texts):
    a_tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_level()

    def one(text):
        if not text:
            return None
        a = a_tool.encode(" " + text, add_special_tokens=False)
        b = b_tool.encode(text)
        a_bytes = [bytes(letters[c] for c in token) for token in a.tokens]
        pieces = [b_tool.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        ends = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                at += len(p)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for cut in cuts:
            next_i, next_j = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a.ids[i:next_i], b[j:next_j]))
            i, j = next_i, next_j
        return a.ids, b, groups

    done = {t: one(t) for t in set(texts)}
    counts = Counter()
    for t in texts:
        if done[t]:
            counts.update({(x, y) for left, right in done[t][2] for x in left for y in right})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = {}
    for t, found in done.items():
        if not found:
            out[t] = (0, 0, 0, 0, 0, 0, "")
            continue
        links = [(x, y) for left, right in found[2] for x in left for y in right]
        line = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in found[2])
        out[t] = (len(found[0]), len(found[1]), len(found[2]), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest())
    return out


def given(spark):
    texts = [*TEXTS, *TEXTS[:3], None, "", "", *["copy of a copy"] * 40]
    rows = [(i if i != 3 else None, t, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (5, "a ", 1, "x", 2), (5, "a ", 1, "x", 2)], SCHEMA)


@pytest.mark.parametrize("known", [alignment.KNOWN_PAIRS, 20, 0])
def test_against_whole_texts(spark, known):
    rows = given(spark).collect()
    want = brute([r.text for r in rows])
    expected = sorted((-1 if r.doc_id is None else r.doc_id, *want[r.text]) for r in rows)
    out = alignment.align(given(spark).repartition(3), known_pairs=known)
    assert out.columns == ["doc_id", *MEASURES, "groups_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.collect()) == expected


def test_slices_of_long_texts(spark, monkeypatch):
    text = "alpha beta,  gamma\n delta " * 300
    whole = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    tools = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "SLICE_CHARS", 50)
    facts, digest, _, times = next(alignment.Words(tools).texts([text]))
    assert times.sum() == facts[3] and times.max() == 301
    assert alignment.unpacked(*alignment.packed(times * 3, times))[1].sum() == facts[3]
    assert (facts.tolist(), digest) == ([whole.n_a, whole.n_b, whole.n_groups, whole.n_links], whole.groups_sha256)
    assert (whole.n_a, whole.n_groups, digest) == (lambda w: (w[0], w[2], w[6]))(brute([text])[text])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = brute([r.text for r in rows])
    out = alignment.align(docs).collect()
    assert sorted(map(tuple, out)) == sorted((r.doc_id, *want[r.text]) for r in rows)


def test_empty_table(spark):
    assert alignment.align(given(spark).limit(0)).count() == 0
