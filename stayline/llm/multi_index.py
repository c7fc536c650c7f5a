"""Near-duplicate vectors by an inverted multi-index: two codebooks, a grid of cells, nearest cells first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import components, smallest_reachable
from stayline.llm.vectors import distinct_vectors, usable
from stayline.session import stored

SIMILARITY = 0.9
CELL_ROWS = 1000  # distinct vectors per cell that the codebook size aims at
SAMPLE = 20_000  # vectors that the codebooks and the number of visits are fitted to
TARGET_RECALL = 0.99
HOME_ROWS, GUEST_ROWS = 2048, 4096  # of one task's block of a cell


def spherical_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres by Lloyd's rounds; an empty centre moves to a random point."""
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = gaps(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            own = points[near == c]
            centres[c] = own.mean(axis=0) if len(own) else points[rng.integers(len(points))]
    return centres


def gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances from points to centres."""
    return np.maximum((points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T, 0)


class Grid:
    """Two codebooks over the halves of unit vectors; a cell is a pair of centres."""

    def __init__(self, sample: np.ndarray, cells: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        k = int(min(max(2, round(np.sqrt(cells))), max(len(sample), 1)))
        self.books = [spherical_means(part, k, rng) for part in self.halves(sample)]
        self.visits = self.fit_visits(sample, rng)

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.half], points[:, self.half :]

    def tables(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.halves(points)
        return gaps(left, self.books[0]), gaps(right, self.books[1])

    def cell(self, points: np.ndarray) -> np.ndarray:
        left, right = self.tables(points)
        return left.argmin(axis=1) * len(self.books[1]) + right.argmin(axis=1)

    def nearest_cells(self, points: np.ndarray, visits: int) -> np.ndarray:
        """The `visits` nearest cells of each point, nearest first.

        Multi-sequence traversal: centres of each half are sorted by distance,
        and of the pairs (i, j) only those with (i + 1) * (j + 1) <= visits can
        be among the nearest, since all pairs below such a pair come before it.
        """
        left, right = self.tables(points)
        a, b = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
        near_a, near_b = np.take_along_axis(left, a, axis=1), np.take_along_axis(right, b, axis=1)
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        in_reach = (i + 1) * (j + 1) <= visits
        i, j = i[in_reach], j[in_reach]
        order = np.argsort(near_a[:, i] + near_b[:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(a, i[order], axis=1) * len(self.books[1]) + np.take_along_axis(b, j[order], axis=1)

    def fit_visits(self, sample: np.ndarray, rng: np.random.Generator, probes: int = 2000) -> int:
        """The fewest visits that find TARGET_RECALL of the links of made-up partners at exactly the least similarity.

        Partners at the threshold in random directions are the hardest links
        there are; nearer ones share cells more often. A link counts as found
        when either end visits the other's cell.
        """
        cells = len(self.books[0]) * len(self.books[1])
        if not len(sample) or cells == 1:
            return cells
        ends = sample[rng.integers(len(sample), size=probes)]
        turn = rng.normal(size=ends.shape)
        turn -= (turn * ends).sum(1, keepdims=True) * ends
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        others = SIMILARITY * ends + np.sqrt(1 - SIMILARITY**2) * turn
        place = np.full(probes, cells)
        for x, y in ((ends, others), (others, ends)):
            hit = self.nearest_cells(x, cells) == self.cell(y)[:, None]
            place = np.minimum(place, hit.argmax(axis=1))
        return int(np.sort(place)[int(np.ceil(TARGET_RECALL * probes)) - 1]) + 1


def unit(vectors) -> np.ndarray:
    points = np.stack(list(vectors)).astype(float)
    # The largest component is taken out first, so that squares neither overflow nor vanish.
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of unit vectors reach the similarity in double precision; rounding of the product is checked again."""
    product = a @ b.T
    yes = product >= similarity
    for i, j in zip(*np.nonzero(np.abs(product - similarity) < 1e-12), strict=True):
        yes[i, j] = (a[i] * b[j]).sum() >= similarity
    return yes


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Links of cosine at least `similarity` between all vectors, and their components.

    Copies of a vector are one point with a weight. Every point has a home
    cell and visits its nearest cells; a block of a cell's residents meets a
    block of residents and visitors in one matrix product, exact in double
    precision, so nothing below the similarity is linked. Blocks have a bounded number of
    rows however full a cell is, and give back counts and a spanning set of
    links, never pairs. A pair that meets twice counts once: where the
    resident also visits the visitor's home, only the smaller visitor counts.

    Returns vec_id, n_links, component_id, kept for every row with an id.
    Unusable vectors (see `usable`) link with nothing and are their own
    component; of rows that share an id the smallest vector stands, and the id
    has one row. Vectors of different dimensions never link. No rows give no
    rows; other columns are not looked at.
    """
    spark = rows.sparkSession
    vectors = stored(usable(rows), "vectors")
    points = stored(distinct_vectors(vectors).withColumn("dim", F.size("embedding")), "points")
    schema = "a long, b long, id long, n_links long"
    found = None
    for dim, count in sorted(points.groupBy("dim").count().collect()):
        some = points.where(F.col("dim") == dim)
        picked = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
        grid = Grid(unit(r["embedding"] for r in picked), count / cell_rows)
        part = spark_links(some, grid, similarity, schema)
        found = part if found is None else found.union(part)
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n_links").alias("more"))
    groups = components(found.where("a is not null").select("a", "b"))
    member = vectors.join(points.select("embedding", F.col("vec_id").alias("point"), "copies"), "embedding").select("vec_id", "point", "copies")
    out = (
        ids.join(member, "vec_id", "left")
        .join(counts, F.col("point") == F.col("id"), "left")
        .join(groups, F.col("point") == F.col("node"), "left")
        .select(
            "vec_id",
            (F.coalesce("more", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component", "point", "vec_id").alias("component_id"),
        )
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def spark_links(points: DataFrame, grid: Grid, similarity: float, schema: str) -> DataFrame:
    """Links among points of one dimension: rows (a, b) that span the components, and rows (id, n_links) that add up."""
    placed_schema = "vec_id long, copies long, cell int, home int, visited array<int>, vector binary"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                vectors = unit(part["embedding"])
                near = grid.nearest_cells(vectors, grid.visits)
                home = grid.cell(vectors)
                # Ties between cells are broken alike in both lists, but the home always counts as visited.
                near[~(near == home[:, None]).any(axis=1), 0] = home[~(near == home[:, None]).any(axis=1)]
                flat = [v.astype("<f8").tobytes() for v in vectors]
                yield pd.DataFrame({
                    "vec_id": np.repeat(part["vec_id"].to_numpy(), near.shape[1]),
                    "copies": np.repeat(part["copies"].to_numpy(), near.shape[1]),
                    "cell": near.ravel(),
                    "home": np.repeat(home, near.shape[1]),
                    "visited": [x for x in near.tolist() for _ in range(near.shape[1])],
                    "vector": [x for x in flat for _ in range(near.shape[1])],
                })

    placed = stored(points.select("vec_id", "copies", "embedding").mapInPandas(place, placed_schema), "cells")
    is_home = F.col("cell") == F.col("home")
    blocks = placed.groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.when(is_home, 1)) / HOME_ROWS)).cast("int").alias("homes"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / GUEST_ROWS)).cast("int").alias("guests"),
    )
    placed = placed.join(blocks, "cell")
    residents = (
        placed.where(is_home)
        .withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.col("homes")).cast("int"))
        .withColumn("column_block", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)))
        .select("cell", "row_block", "column_block", "vec_id", "copies", "visited", "vector")
    )
    guests = (
        placed.withColumn("g_column", F.pmod(F.xxhash64("vec_id"), F.col("guests")).cast("int"))
        .withColumn("g_row", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
        .select(F.col("cell").alias("g_cell"), "g_row", "g_column", *[F.col(c).alias(f"g_{c}") for c in ("vec_id", "copies", "home", "vector")])
    )
    width = sum(b.shape[1] for b in grid.books)

    def meet(residents: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "id": [], "n_links": []}, dtype="Int64")
        if not len(residents) or not len(guests):
            return empty
        a, b = (np.frombuffer(b"".join(x), dtype="<f8").reshape(-1, width) for x in (residents["vector"], guests["g_vector"]))
        ids, others = residents["vec_id"].to_numpy(), guests["g_vec_id"].to_numpy()
        weights, other_weights = residents["copies"].to_numpy(), guests["g_copies"].to_numpy()
        yes = linked(a, b, similarity)
        yes &= ids[:, None] != others[None, :]
        rows, columns = np.flatnonzero(yes.any(axis=1)), np.flatnonzero(yes.any(axis=0))
        if not len(rows):
            return empty
        yes = yes[np.ix_(rows, columns)]
        visited = np.stack(residents["visited"].iloc[rows].to_numpy())
        homes = guests["g_home"].to_numpy()[columns]
        cell_of = int(residents["cell"].iloc[0])
        # The pair meets twice when the resident visits the guest's home too, or when both live here.
        twice = np.zeros(yes.shape, dtype=bool)
        for home in np.unique(homes):
            same = homes == home
            twice[:, same] = ((visited == home).any(axis=1) | (home == cell_of))[:, None]
        counted = yes & (~twice | (others[columns][None, :] < ids[rows][:, None]))
        left, right = smallest_reachable(yes, ids[rows], others[columns])
        links = pd.DataFrame({"a": np.concatenate((ids[rows], others[columns])), "b": np.concatenate((left, right))})
        n_left = (counted * other_weights[columns][None, :]).sum(axis=1)
        n_right = (counted * weights[rows][:, None]).sum(axis=0)
        adds = pd.DataFrame({"id": np.concatenate((ids[rows], others[columns])), "n_links": np.concatenate((n_left, n_right))}).groupby("id", as_index=False).sum()
        return pd.concat((links[links["a"] != links["b"]].drop_duplicates(), adds)).astype("Int64")[["a", "b", "id", "n_links"]]

    return residents.groupBy("cell", "row_block", "column_block").cogroup(guests.groupBy("g_cell", "g_row", "g_column")).applyInPandas(meet, schema)
