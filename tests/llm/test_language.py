from collections import Counter

import pytest

from stayline.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, gram int, place string"


def plain_grams(text):
    counts = Counter()
    word = ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            word += ch
            continue
        if word:
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
        word = ""
    return counts


def code(gram):
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


def ranked(counts, size):
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


def brute(profiles, text, size):
    mine = ranked(plain_grams(text or ""), size)
    if not mine:
        return "und", 0.0
    near = {lang: sum(size - min(size, abs(p.index(g) - i)) for i, g in enumerate(mine) if g in p) for lang, p in profiles.items()}
    best = min(profiles, key=lambda lang: (-near[lang], lang))
    return best, near[best] / sum(near.values()) if sum(near.values()) else 1 / len(profiles)


def documents(spark):
    rows = [(i, t, lang, "s", 1, "x") for i, (t, lang) in enumerate([("the cat sat on the mat " * 3, "en"), ("le chat était là, où ça? " * 2, "fr"), ("Die Katze saß auf der Straße", "de")] * 12)]
    rows += [(100, "", "en", "s", 1, "x"), (101, None, "en", "s", 1, "x"), (102, "123 !!", None, "s", 1, "x"), (103, "漢字 ÀÉ", None, "s", 1, "x")]
    rows += [(None, "the mat", "xx", "s", 1, "x"), (104, "the cat", None, "s", 1, "x"), (104, "the cat", None, "s", 1, "x"), (105, "sat the " * 300_000, "en", "s", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_against_plain_python(spark):
    from zlib import crc32

    rows = documents(spark).collect()
    counts = {}
    for r in rows:
        if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang and r.text:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: ranked(c, 60) for lang, c in counts.items()}
    out = language.identify(documents(spark).repartition(3), 60).collect()
    assert len(out) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    for r in out:
        want = brute(profiles, texts[r.doc_id], 60)
        assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1]))
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)


def test_empty_and_untaught(spark):
    assert language.identify(documents(spark).limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(documents(spark).where("lang is null")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
