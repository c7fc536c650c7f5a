"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.vectors import distinct_vectors, usable
from stayline.session import stored

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
LINKS = 16  # of a node in an upper layer; twice as many in the lowest
BUILD_BEAM, SEARCH_BEAM = 80, 200
INSERT_BATCH = 512
STEP_NODES = 4  # nodes that a search opens at once


def one_length(points: np.ndarray) -> np.ndarray:
    """The vectors over the longest one's length, with one more component that brings all to length 1.

    The largest component is divided out first, so no square overflows. Within
    one band of lengths the added component never swamps the others.
    """
    points = points / np.abs(points).max()
    points = points / np.sqrt((points * points).sum(axis=1).max())
    return np.hstack((points, np.sqrt(np.maximum(1 - (points * points).sum(axis=1), 0))[:, None]))


class Graph:
    """A small-world graph over vectors in layers, each layer a flat array of neighbours (-1: none).

    Nearness is the inner product, turned into Euclidean distance by one more
    component that brings all vectors to one length. Nodes enter in batches:
    all nodes of a batch search the graph so far side by side in numpy.
    """

    def __init__(self, points: np.ndarray, seed: int = 3, links: int = LINKS, beam: int = BUILD_BEAM):
        self.points = one_length(points)
        n = len(points)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 8)
        self.links, self.beam = links, beam
        order = np.argsort(-self.levels, kind="stable")  # upper nodes first: every layer is entered through finished ones
        self.entry = int(order[0])
        self.layers = [np.full((n, links * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(int(self.levels.max()) + 1)]
        at, size = 1, 1
        while at < n:
            self.insert(order[at : at + size])
            at += size
            size = min(size * 2, INSERT_BATCH)

    @classmethod
    def stored(cls, points: np.ndarray, entry: int, layers: list[np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.points = one_length(points)
        graph.entry, graph.layers = entry, layers
        return graph

    def away(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances from each query to its row of nodes; infinite for -1."""
        gap = self.points[nodes] - queries[:, None, :]
        return np.where(nodes >= 0, np.einsum("qnd,qnd->qn", gap, gap), np.inf)

    def walk(self, queries: np.ndarray, starts: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search in one layer for all queries at once: the nearest nodes found, nearest first, and their distances."""
        q = len(queries)
        rows = np.arange(q)[:, None]
        nodes = np.full((q, beam), -1, dtype=np.int64)
        gaps = np.full((q, beam), np.inf)
        opened = np.ones((q, beam), dtype=bool)
        starts = starts[:, :beam]
        width = starts.shape[1]
        nodes[:, :width] = starts
        gaps[:, :width] = self.away(queries, starts)
        opened[:, :width] = starts < 0
        seen = np.zeros((q, len(self.points) + 1), dtype=bool)  # the last place takes -1
        seen[rows, starts] = True
        seen[:, -1] = True
        step = min(STEP_NODES, beam)
        live = np.arange(q)
        while len(live):
            shut = np.where(opened[live], np.inf, gaps[live])
            pick = np.argpartition(shut, step - 1, axis=1)[:, :step]
            todo = np.isfinite(np.take_along_axis(shut, pick, axis=1))
            going = todo.any(axis=1)
            live, pick, todo = live[going], pick[going], todo[going]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            from_nodes = np.where(todo, nodes[live[:, None], pick], -1)
            near = np.where(from_nodes[:, :, None] >= 0, self.layers[layer][from_nodes], -1).reshape(len(live), -1).astype(np.int64)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            found = self.away(queries[live], near)
            all_nodes = np.hstack((nodes[live], near))
            all_gaps = np.hstack((gaps[live], found))
            all_open = np.hstack((opened[live], near < 0))
            best = np.argsort(all_gaps, axis=1, kind="stable")[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, best, axis=1)
            gaps[live] = np.take_along_axis(all_gaps, best, axis=1)
            opened[live] = np.take_along_axis(all_open, best, axis=1)
        order = np.argsort(gaps, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(gaps, order, axis=1)

    def choose(self, nodes: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` diverse neighbours per row: a candidate nearer to a chosen one than to the node waits behind the others."""
        width = nodes.shape[1]
        points = self.points[nodes]
        chosen = np.zeros(nodes.shape, dtype=bool)
        to_chosen = np.full(nodes.shape, np.inf)
        count = np.zeros(len(nodes), dtype=int)
        for at in range(width):
            take = (gaps[:, at] < to_chosen[:, at]) & np.isfinite(gaps[:, at]) & (count < most)
            if not take.any():
                continue
            chosen[take, at] = True
            count += take
            gap = points[take] - points[take, at][:, None, :]
            to_chosen[take] = np.minimum(to_chosen[take], np.einsum("qnd,qnd->qn", gap, gap))
        rank = np.where(np.isfinite(gaps), np.where(chosen, 0, 1) * width + np.arange(width), 3 * width)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(nodes, order, axis=1)
        return np.where(np.take_along_axis(rank, order, axis=1) < 3 * width, picked, -1)

    def insert(self, batch: np.ndarray) -> None:
        queries = self.points[batch]
        starts = np.full((len(batch), 1), self.entry, dtype=np.int64)
        levels = self.levels[batch]
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = levels >= layer
            nodes, gaps = self.walk(queries, starts, layer, self.beam if inside.any() else 1)
            starts = nodes[:, : self.beam]
            if not inside.any():
                continue
            own, near, far = batch[inside], nodes[inside], gaps[inside]
            # Nodes of one batch do not see each other in the graph, so they are compared here.
            mates = np.broadcast_to(own, (len(own), len(own))).copy()
            np.fill_diagonal(mates, -1)
            flat = self.points[own]
            between = np.maximum((flat * flat).sum(1)[:, None] + (flat * flat).sum(1)[None, :] - 2 * flat @ flat.T, 0)
            between[mates < 0] = np.inf
            near, far = np.hstack((near, mates)), np.hstack((far, between))
            best = np.argsort(far, axis=1, kind="stable")[:, : self.beam]
            near, far = np.take_along_axis(near, best, axis=1), np.take_along_axis(far, best, axis=1)
            links = self.layers[layer]
            picked = self.choose(near, far, self.links)
            links[own, : picked.shape[1]] = picked
            self.link_back(layer, np.repeat(own, picked.shape[1]), picked.ravel())

    def link_back(self, layer: int, sources: np.ndarray, targets: np.ndarray) -> None:
        """Add the sources to their targets' neighbours; where there are too many, choose again."""
        ok = targets >= 0
        sources, targets = sources[ok], targets[ok]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        own, first, count = np.unique(targets, return_index=True, return_counts=True)
        links = self.layers[layer]
        more = np.full((len(own), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
        place = np.arange(len(targets)) - np.repeat(first, count)
        more[np.repeat(np.arange(len(own)), count), place] = sources
        both = np.sort(np.hstack((links[own], more)), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for at in range(0, len(own), 2048):
            part, nodes = own[at : at + 2048], both[at : at + 2048]
            gaps = self.away(self.points[part], nodes)
            best = np.argsort(gaps, axis=1, kind="stable")
            nodes, gaps = np.take_along_axis(nodes, best, axis=1), np.take_along_axis(gaps, best, axis=1)
            width = max(int(np.isfinite(gaps).sum(axis=1).max()), 1)
            picked = self.choose(nodes[:, :width], gaps[:, :width], links.shape[1])
            links[part] = -1
            links[part[:, None], np.arange(picked.shape[1])[None, :]] = picked

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Nodes near each query by inner product, nearest first; -1 fills up."""
        queries = queries / np.abs(queries).max(axis=1, keepdims=True)
        queries = np.hstack((queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True)), np.zeros((len(queries), 1))))
        out = []
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256]
            starts = np.full((len(part), 1), self.entry, dtype=np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                starts = self.walk(part, starts, layer, 4)[0]
            out.append(self.walk(part, starts, 0, beam)[0])
        return np.concatenate(out)


def build(points: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = 3) -> DataFrame:
    """One row per shard: its distinct vectors, the ids of each, and its graph, all as flat arrays.

    Shards are dealt by a hash of the vector and hold about `shard_rows`
    vectors of one dimension and one band of lengths, each band reaching to
    twice its shortest, so a few long vectors do not blur the others. `points`
    has embedding and ids, as `distinct_vectors` makes them.
    """
    largest = F.array_max(F.transform("embedding", F.abs))
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + (x / F.col("largest")) * (x / F.col("largest")))
    # The shift keeps lengths around 1 in one band.
    banded = points.withColumn("dim", F.size("embedding")).withColumn("largest", largest)
    banded = banded.withColumn("band", F.floor(F.log2("largest") + F.log2(square) / 2 + 0.37).cast("int")).drop("largest")
    sizes = stored(banded.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).alias("shards")), "sizes")
    tasks = 4 * (sizes.agg(F.sum("shards")).first()[0] or 1)  # so that graphs, which take long, seldom share a task

    def graph_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        vectors = np.stack(rows["embedding"].to_numpy()).astype(float)
        graph = Graph(vectors, seed)
        ids = [np.asarray(x, dtype=np.int64) for x in rows["ids"]]
        return pd.DataFrame([{
            "band": int(rows["band"].iloc[0]),
            "shard": int(rows["shard"].iloc[0]),
            "dim": vectors.shape[1],
            "vectors": vectors.astype("<f8").tobytes(),
            "ids": np.concatenate(ids).astype("<i8").tobytes(),
            "id_counts": np.array([len(x) for x in ids], dtype="<i4").tobytes(),
            "entry": graph.entry,
            "layers": [layer.astype("<i4").tobytes() for layer in graph.layers],
        }])

    keyed = banded.join(sizes, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), "shards").cast("int")).drop("shards")
    schema = "band int, shard int, dim int, vectors binary, ids binary, id_counts binary, entry int, layers array<binary>"
    return keyed.repartition(tasks, "dim", "band", "shard").groupBy("dim", "band", "shard").applyInPandas(graph_of, schema)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each query vector the `k` nearest rows found: query_id, rank, vec_id, score.

    Score is the inner product in double precision over the given vectors;
    ties go to the smaller vec_id; a query's own id is no candidate. Copies of
    a vector are one node with its k + 1 smallest ids, so no copy is lost that
    could be among the k. Graphs are built per shard and written as flat
    arrays; the query set goes to every shard in blocks, and each shard's best
    are merged per query. Unusable vectors (see `usable`) neither ask nor
    answer, nor do vectors of another dimension. `rows` and `queries` may be
    empty and may have other columns.
    """
    index = stored(build(distinct_vectors(usable(rows), k + 1), shard_rows), "graphs")
    shards = index.select(F.col("dim").alias("of_dim"), F.col("band").alias("to_band"), F.col("shard").alias("to_shard")).distinct()
    asked = usable(queries).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.join(shards, F.col("dim") == F.col("of_dim"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(block):
            return pd.DataFrame({n: [] for n in names})
        g = graph.iloc[0]
        vectors = np.frombuffer(g["vectors"], dtype="<f8").reshape(-1, g["dim"])
        ids, counts = np.frombuffer(g["ids"], dtype="<i8"), np.frombuffer(g["id_counts"], dtype="<i4")
        first = np.cumsum(counts) - counts
        layers = [np.frombuffer(x, dtype="<i4").reshape(len(vectors), -1) for x in g["layers"]]
        asks = np.stack(block["embedding"].to_numpy()).astype(float)
        found = Graph.stored(vectors, int(g["entry"]), layers).search(asks, max(beam, k + 1))
        out = []
        for query_id, ask, nodes in zip(block["vec_id"], asks, found, strict=True):
            nodes = nodes[nodes >= 0]
            scores = (vectors[nodes] * ask).sum(axis=1)
            best = np.lexsort((ids[first[nodes]], -scores))[: k + 1]
            nodes, scores = nodes[best], scores[best]
            own = np.concatenate([ids[first[n] : first[n] + counts[n]] for n in nodes])
            score = np.repeat(scores, counts[nodes])
            keep = own != query_id
            own, score = own[keep], score[keep]
            top = np.lexsort((own, -score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": own[top], "score": score[top]}))
        return pd.concat(out)

    pairs = graphs.groupBy("dim", "band", "shard", "block").cogroup(asked.groupBy("of_dim", "to_band", "to_shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
