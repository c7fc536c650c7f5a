import re

import pytest

from stayline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, key int"


def water(sizes, weights, cap=3):
    """Sharing round by round, as the rule says."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, got, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(got[s] for s in full)
        free = [s for s in names if s not in full]
        got |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return got
        for s in over:
            got[s] = cap * sizes[s]
            full.add(s)


def documents(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 3}", "x", 1) for i in range(300)]
    rows += [(1000 + i, "one two", "Ä", "x", 1) for i in range(3)] + [(2000, "a b c\tz", None, "x", 1), (2001, None, None, "x", 1), (None, "n n", "s1", "x", 1)]
    rows += [(5, "w " * 5, "s2", "x", 1)] * 4 + [(3000, "", "empty", "x", 1), (3001, "long " * 50_000, "s0", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_budgets(spark):
    rows = mixing.mix(documents(spark)).collect()
    texts = {(r.doc_id, r.source): r.text for r in documents(spark).collect()}
    assert len(rows) == documents(spark).count()
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[(r.doc_id, r.source)] or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water(sizes, [5, 2, 1])
    for source, size in sizes.items():
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[source])
        assert abs(sum(r.taken for r in own) - want[source]) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    again = mixing.mix(documents(spark).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark).where("doc_id in (2001, 3000)")).collect()] == [0, 0]


def test_whole_documents(spark):
    df = documents(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    texts = {r.text for r in df.collect()}
    assert all(r.text in texts for r in out.collect())
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert counts and max(n for i, n in counts.items() if i != 5) <= 3
