import hashlib
import re

from stayline.llm import pii

SCHEMA = "doc_id long, text string, kind string, row int, hit int, list int"
# Plain forms of the base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TEXTS = [
    None, "", "nothing here 123", "mail a.b@c.example.org, x@y.z! 10.0.0.1 and 256.1.1.1 and 001.002.003.004.5.6.7.8",
    "a@b a@b.c%d@e.f.g@h.i @@ x@.y", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 1234567890123456789012", "+1 (375) 555-4393 +12345 +1+2+3 +49.30.1234567-+1 555 123 4567.",
    "漢字😀 é user@exämple.org 😀 me@host.org 1.2.3.4😀", "1.2.3 .4 1.2.3.4.5 0.0.0.0 999.9.9.9 1.2.3.4", "x@y.z" * 50, "a" * 6000, "1" * 3000, "a." * 3000, "+1" * 3000, "1 " * 50_000,
    "a@b." * 30_000, ("word " * 20 + "q@r.st ") * 800, "- 4111 1111 1111 1111 - 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 ", "mail:x@y.zz\n\tip=1.1.1.1;",
]


def test_base_spans_against_plain_regex(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1, 2, 3), (None, TEXTS[3], "x", 1, 2, 3)]
    out = pii.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = base_spans(TEXTS[3 if r.doc_id is None else r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), r.doc_id
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("id:")) == said
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in BASE]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.report(df).count() == 0 and pii.masked(df).count() == 0


def test_contexts_of_seeds_find_other_identifiers(spark):
    filler = "some plain words that stand in every text"
    rows = [(i, f"{filler} kontakt: user{i}@mail.example.org end {filler}", "x", 1, 2, 3) for i in range(12)]
    rows += [(100, f"{filler} kontakt: user7745-at-mail end {filler}", "x", 1, 2, 3), (101, f"{filler} version build20240101 of words {filler}", "x", 1, 2, 3)]
    rows += [(102, f"{filler} elsewhere user7745-at-mail again", "x", 1, 2, 3), (103, f"{filler} kontakt: nobody end", "x", 1, 2, 3)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in (100, 102):  # found by its context once, known as an instance everywhere
        (span,) = out[i]["list"]
        assert rows[[r[0] for r in rows].index(i)][1][span.start : span.end] == "user7745-at-mail"
    assert out[101].spans == out[103].spans == ""
    assert all(out[i].n_email == 1 and out[i].n_id == 0 for i in range(12))


def test_masking(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1, 2, 3), (None, TEXTS[6], "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pii.masked(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[6 if r.doc_id is None else r.doc_id]
        want, at = "", 0
        for k, a, b in sorted(base_spans(text), key=lambda s: (s[1], s[2])):
            if a >= at:
                want += text[at:a] + f"<{k.upper()}>"
            at = max(at, b)
        assert r.text == (None if text is None else want + text[at:]), r.doc_id


def test_plan_has_no_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame in (pii.report(df), pii.masked(df)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_runs_take_linear_time(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(["a" * 2_000_000, "1" * 2_000_000, "a." * 1_000_000, "+1" * 1_000_000])]
    assert [r.base_sha256 for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()] == [hashlib.sha256(b"").hexdigest()] * 4


def ids_of(spark, texts):
    out = pii.find(spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    return sorted(texts[r.doc_id][x.start : x.end] for r in out for x in r.list if x.kind == pii.TOKEN)


def test_words_of_patterns_are_counted_once_over_whole_texts(spark):
    dense = [f"Email: user{i}@mail.org Phone: +1 555 123 45{i}0" for i in range(8)]
    assert ids_of(spark, dense + ["Email: user7745-at-mail Phone: none"]) == ["user7745-at-mail"]
    # A word that stands far from identifiers most of the time says nothing.
    far = ["plain words that hold no identifier at all. " * 5 + "kontakt: them " + "and more words without any. " * 5] * 40
    assert ids_of(spark, [f"kontakt: user{i}@mail.org end{'x' * i}" for i in range(8)] + far + ["kontakt: user7745-at-mail again"]) == []


def test_word_totals(spark):
    texts = ["see a@b.cc,d@e.ff see SEE mail:x@y.zz. see", "12 see, 34\n12"]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)
    found = pii.free_tokens(pii.located(pii.scan(docs)))
    totals = {r.word: r.total for r in pii.word_totals(docs, pii.beside(found)).collect()}
    assert totals == {"see": 4, "a@b.cc,d@e.ff": 1, ",": 1, "mail:x@y.zz.": 1, "mail:": 1, "see,": 1, "00": 3, ".": 1}


def test_found_identifiers_bring_patterns_of_their_own(spark):
    # Each label but the first stands beside identifiers that only the label before it confirms, never beside a seed.
    labels = ["kontakt:", "passport:", "account:", "member:", "holder:"]
    texts, want = [f"kontakt: user{i}@mail.org" for i in range(40)], []
    for k, label in enumerate(labels):
        for i in range(6):
            if k:
                texts += [f"{label} a{k - 1}-{i}77451 x{k}{'y' * i}"] * 3
            texts.append(f"{label} a{k}-{i}77451 z{k}{'y' * i}")
            want += [f"a{k}-{i}77451"] * (4 if k + 1 < len(labels) else 1)
    assert ids_of(spark, texts + ["build: b8-12345 no label", "none: b9-12345 no label"]) == sorted(want)
