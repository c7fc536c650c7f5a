import math

import numpy as np
import pytest

from stayline.llm import hnsw, multi_index
from stayline.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, copies int"


def rows(n=900, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)).astype(np.float32)
    points[100:220] = points[100] + 0.12 * rng.normal(size=(120, dim))  # one group of near copies
    points[300:360] = points[300]  # copies
    points[400:440] = points[300] * np.float32(2)  # the same direction, longer
    out = [(i, [float(x) for x in p], 0, "x", 1) for i, p in enumerate(points)]
    out += [(2000, None, 0, "x", 1), (2020, [], 0, "x", 1), (2040, [0.0] * dim, 0, "x", 1), (2060, [math.nan] * dim, 0, "x", 1)]
    out += [(2080, [math.inf] + [0.0] * (dim - 1), 0, "x", 1), (2100, [None] * dim, 0, "x", 1), (None, [1.0] * dim, 0, "x", 1)]
    out += [(2120, [1.0, 2.0], 0, "x", 1), (2140, [2.0, 4.0], 0, "x", 1), out[40], out[40]]
    return out


def good(data):
    kept = {}
    for i, v, *_ in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = np.array(v, dtype=np.float32).astype(float)
    return kept


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_neighbours(spark, shard_rows):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    vectors = good(rows())
    out = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=shard_rows).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = {i for i in vectors if i % 20 == 0}
    assert set(out) == asked
    hits = total = 0
    for q in asked:
        scores = {i: float((v * vectors[q]).sum()) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        got = [out[q][k] for k in sorted(out[q])]
        assert sorted(out[q]) == list(range(1, len(want) + 1))
        assert all(score == pytest.approx(scores[i], abs=1e-12) for i, score in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0])) and len({i for i, _ in got}) == len(got)
        hits += len({i for i, _ in got} & set(want))
        total += len(want)
    assert hits / total > 0.97


@pytest.mark.parametrize("odd", [{3: 1e4}, {3: 1e8}, {3: 1e4, 8: 1e-6, 9: 1e-9}, None])
def test_vectors_of_unlike_length(spark, odd):
    """A few long or short vectors, or all of a huge length, leave the neighbours of the others as they are."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for at, factor in (odd or {}).items():
        vectors[at] *= factor
    vectors = vectors * (1e150 if odd is None else 1)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x", 1) for i, v in enumerate(vectors)], SCHEMA.replace("<float>", "<double>"))
    out = hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=600).collect()
    hits = 0
    for q in range(0, 1500, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        got = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])]
        assert len(got) == 20 and [scores[i] for i in got] == sorted((scores[i] for i in got), reverse=True)
        hits += len(set(got) & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (75 * 20) > 0.95


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hnsw.nearest(empty, empty).count() == 0
    assert multi_index.near_duplicates(empty).count() == 0
    df = spark.createDataFrame(rows(), SCHEMA)
    assert hnsw.nearest(df, empty).count() == 0


@pytest.mark.parametrize("cell_rows", [1000, 20])
def test_links(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(multi_index, "HOME_ROWS", 50)
    monkeypatch.setattr(multi_index, "GUEST_ROWS", 70)
    out = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows(), SCHEMA).repartition(3), cell_rows=cell_rows).collect()}
    vectors = {i: v / np.sqrt((v * v).sum()) for i, v in good(rows()).items()}
    assert set(out) == {i for i, *_ in rows() if i is not None}
    links = {i: {j for j, w in vectors.items() if j != i and len(w) == len(v) and (v * w).sum() >= 0.9} for i, v in vectors.items()}
    found, there = sum(r.n_links for r in out.values()), sum(map(len, links.values()))
    assert found <= there and found >= 0.97 * there
    assert all(out[i].n_links <= len(links.get(i, ())) for i in out)
    for i in out:
        if not links.get(i):
            assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert {out[i].component_id for i in (*range(300, 360), *range(400, 440))} == {out[300].component_id}
    assert all(out[i].kept == (out[i].component_id == i) for i in out)


def test_nearest_cells_is_the_true_order():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    grid = multi_index.Grid(points, 36)
    left, right = grid.tables(points)
    total = (left[:, :, None] + right[:, None, :]).reshape(len(points), -1)
    for visits in (1, 3, 10, total.shape[1]):
        got = grid.nearest_cells(points, visits)
        assert np.allclose(np.take_along_axis(total, got, axis=1), np.sort(total, axis=1)[:, :visits])


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(1500, x) for x in range(1501, 1600)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in parent}
