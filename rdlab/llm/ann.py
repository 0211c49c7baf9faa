"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors become points on a sphere by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of the shard, so
that the nearest point is the one with the largest inner product. A node is skipped when the triangle
inequality shows that its ball lies farther than the k-th best so far; `factor` scales the slack:
1 is exact, larger ones skip more. Shards are the cells of a few pivots: a query searches its home cell first, and then only the
cells that the same inequality can't exclude. A shard holds norms within a factor of two only, so that no outlier
squeezes the others together; trees propose within a margin for rounding, the products of the original vectors decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.llm.common import Tables

LEAF = 256
MARGIN = 1e-9  #: of squared distances on the unit sphere; far above what rounding of some 100,000 components can add


class VpTree:
    """Points in leaves of a binary tree split by distance to a vantage point; searched with many queries at once."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points, self.rng = points, np.random.default_rng(seed)
        self.square = (points * points).sum(1)
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        v = at[self.rng.integers(len(at))]
        d = np.linalg.norm(self.points[at] - self.points[v], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = order[:half], order[half:]
        if d[order[0]] == d[order[-1]]:
            return at  # all at one distance: nothing to split by
        return (v, d[near].min(), d[near].max(), d[far].min(), d[far].max(), self._build(at[near]), self._build(at[far]))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(positions, squared distances), each len(queries) x k, unordered; position -1 where there are fewer points."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        qs = (queries * queries).sum(1)
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, who, least = stack.pop()
            keep = least * factor <= np.sqrt(best[who].max(1)) + 1e-6
            who, least = who[keep], least[keep]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                d = np.maximum(self.square[node][None, :] + qs[who][:, None] - 2 * queries[who] @ self.points[node].T, 0)
                d, p = np.hstack([best[who], d]), np.hstack([found[who], np.broadcast_to(node, (len(who), len(node)))])
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[who], found[who] = np.take_along_axis(d, top, 1), np.take_along_axis(p, top, 1)
                continue
            v, near_lo, near_hi, far_lo, far_hi, near, far = node
            d = np.sqrt(np.maximum(self.square[v] + qs[who] - 2 * queries[who] @ self.points[v], 0))
            to_near = np.maximum(least, np.maximum(d - near_hi, near_lo - d))
            to_far = np.maximum(least, np.maximum(d - far_hi, far_lo - d))
            first = d < (near_hi + far_lo) / 2
            stack += [(far, who[first], to_far[first]), (near, who[~first], to_near[~first]), (near, who[first], to_near[first]), (far, who[~first], to_far[~first])]
        return found, best


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, band): band is the exponent of the norm, computed on components scaled by the largest, so that none over- or underflows."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(~bad, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("vec")).withColumn("most", F.array_max(F.transform("vec", lambda v: F.abs(v)))).where("most > 0")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v / F.col("most")) * (v / F.col("most"))))
    return rows.select("id", "vec", F.floor(F.log2("most") + F.log2(norm)).cast("int").alias("band"))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component of each between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _search(k: int, factor: float):
    def product(raw: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.add.accumulate(raw * q, axis=1)[:, -1]  # added left to right, the same in any place

    def answer(tree: VpTree, raw: np.ndarray, owners: list[np.ndarray], qid: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        unit = _scaled(q)
        unit = np.hstack([unit / np.linalg.norm(unit, axis=1)[:, None], np.zeros((len(q), 1))])
        out: list = [None] * len(q)
        todo, many = np.arange(len(q)), min(k + 8, len(raw))
        while len(todo):
            found, far = tree.search(unit[todo], many, factor)
            close = np.sort(far, axis=1)
            # a query whose last candidates all tie with its k-th best could have more of them
            short = (close[:, -1] <= close[:, min(k, many - 1)] + MARGIN) & (many < len(raw))
            for i, at in zip(todo[~short], found[~short], strict=True):
                at = at[at >= 0]
                score = product(raw[at], q[i])
                ids = np.concatenate([owners[x] for x in at])
                score = np.repeat(score, [len(owners[x]) for x in at])[ids != qid[i]]
                ids = ids[ids != qid[i]]
                order = np.lexsort((ids, -score))[:k]
                out[i] = (int(qid[i]), ids[order], score[order])
            todo, many = todo[short], min(4 * many, len(raw))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    def grown(points: list) -> tuple[VpTree, np.ndarray, list[np.ndarray]]:
        """The tree of the distinct vectors, and for each its k + 1 smallest ids."""
        ids, raw = np.concatenate([p[0] for p in points]), np.concatenate([p[1] for p in points])
        order = np.lexsort((ids, *raw.T[::-1]))
        ids, raw = ids[order], raw[order]
        new = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]).any(1)])
        raw = raw[new]
        x = np.ldexp(raw, -int(np.frexp(np.abs(raw).max())[1]))
        n2 = (x * x).sum(1)
        lifted = np.hstack([x, np.sqrt(np.maximum(n2.max() - n2, 0))[:, None]]) / np.sqrt(n2.max())
        return VpTree(lifted), raw, [x[: k + 1] for x in np.split(ids, new[1:])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard, points before queries."""
        shard, points, tree = None, [], None
        for pdf in parts:
            for s, group in pdf.groupby("shard", sort=False):
                if s != shard:
                    shard, points, tree = s, [], None
                data, ask = group[~group["ask"]], group[group["ask"]]
                if len(data):
                    points.append((data["id"].to_numpy(), np.stack(data["vec"].to_numpy())))
                if len(ask) and points:
                    if tree is None:
                        tree = grown(points)
                    q, qid = np.stack(ask["vec"].to_numpy()), ask["id"].to_numpy()
                    for i in range(0, len(q), 512):
                        yield answer(*tree, qid[i : i + 512], q[i : i + 512])

    return run


class Cells:
    """Pivots, each a point of one band, and the least and largest distances of the points in their cells."""

    def __init__(self, bands: np.ndarray, vectors: np.ndarray):
        self.bands, self.points = bands, lifted(vectors, bands)
        self.low, self.high = np.zeros(len(bands)), np.full(len(bands), 2.0)

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points * points).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * points @ self.points.T, 0))

    def place(self, vectors: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each point among those of its band, and its distance."""
        d = np.where(bands[:, None] == self.bands[None, :], self.distances(lifted(vectors, bands)), np.inf)
        cell = d.argmin(1)
        return cell, d[np.arange(len(d)), cell]

    def bounds(self, queries: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell: the product of the unit query and the pivot, and the largest that a point of the cell can have, both with the band's scale."""
        unit = _scaled(queries)
        unit = np.hstack([unit / np.linalg.norm(unit, axis=1)[:, None], np.zeros((len(queries), 1))])
        d = self.distances(unit)
        least = np.maximum(np.maximum(d - self.high, self.low - d) - 1e-6, 0) * factor
        scale = np.ldexp(1.0, np.clip(self.bands + 1, -1000, 1000))[None, :]
        return scale * (1 - d * d / 2), scale * (1 - np.minimum(least, 2.0) ** 2 / 2 + MARGIN)


def lifted(vectors: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Points on the unit sphere of vectors of norms below 2^(band + 1)."""
    x = np.ldexp(vectors, -(bands + 1)[:, None])
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])


def _pivots(base: DataFrame, shards: dict[int, int], most: int) -> Cells:
    """At most `most` pivots, and one for each band, from a bounded sample by the hash of the rows; in each band far from one another."""
    n = sum(shards.values())
    want = {b: max(1, min(m, most * m // n)) for b, m in shards.items()}
    first = base.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "vec").alias("h"), "vec")).alias("x")).select("band", "x.vec")
    rows = [*first.collect(), *base.orderBy(F.xxhash64("id", "vec"), "id", "vec").select("band", "vec").limit(4 * most).collect()]
    bands, vectors = [], []
    for b in sorted(want):
        own = np.unique(np.array([r["vec"] for r in rows if r["band"] == b], float), axis=0)
        points = lifted(own, np.full(len(own), b))
        chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(want[b], len(own)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        bands += [b] * len(chosen)
        vectors.append(own[chosen])
    return Cells(np.array(bands), np.concatenate(vectors))


def _placed(cells):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                if len(part):
                    cell, far = cells.value.place(np.stack(part["vec"].to_numpy()), part["band"].to_numpy())
                    yield pd.DataFrame({"cell": cell, "far": far, "id": part["id"].to_numpy(), "vec": part["vec"].to_numpy()})

    return run


def _visits(cells, factor: float, home: bool):
    """(cell, id, vec): the cell where a query's best pivot is, or all others that may hold a product of at least `kth`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                if not len(part):
                    continue
                q = np.stack(part["vec"].to_numpy())
                near, most = cells.value.bounds(q, factor)
                at_home = near.argmax(1)
                if home:
                    who, cell = np.arange(len(q)), at_home
                else:
                    with np.errstate(all="ignore"):
                        kth = part["kth"].to_numpy(float) / np.linalg.norm(q, axis=1)
                    sure = np.isfinite(kth) & (np.abs(q).max(1) < 1e150) & (np.abs(q).max(1) > 1e-150)
                    go = ~sure[:, None] | (most >= kth[:, None]) | (np.abs(cells.value.bands) > 900)[None, :]
                    go[np.arange(len(q)), at_home] = False
                    who, cell = np.nonzero(go)
                yield pd.DataFrame({"cell": cell, "id": part["id"].to_numpy()[who], "vec": part["vec"].to_numpy()[who]})

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, pivots: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of base with the largest inner product, itself (the same id) left out.

    Nearest first, ties to the smaller id; all there are if fewer than k. Rows with a null id and vectors
    that are null, empty, zero or hold null or non-finite components take no part on either side; very small and very large ones do, and a
    product beyond the range of doubles is infinite. All vectors
    have the same length. Repeated ids are separate rows; an empty table gives no rows; other columns are not read. Base rows fall into bands by the
    power of two of their norm (of which doubles have some 2,100) and into the cells of at most `pivots` pivots (one a band at least), the only
    vectors that come to the driver besides a sample of four times as many; a cell of more than shard_rows rows is dealt to shards by a hash of id and vector. A
    query visits its home cell, then those cells that may hold one of its k nearest. A task holds one shard at a time.
    """
    spark = base.sparkSession
    base, queries = _clean(base, id_col, vec_col), _clean(queries, id_col, vec_col)
    bands = {r["band"]: -(-r["n"] // shard_rows) for r in base.groupBy("band").agg(F.count("*").alias("n")).collect()}
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tables, cells = Tables(spark), _pivots(base, bands, pivots)
    dealt = tables.written(base.mapInPandas(_placed(spark.sparkContext.broadcast(cells)), "cell long, far double, id long, vec array<double>"), "cells")
    shards = np.ones(len(cells.bands), int)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        shards[r["cell"]] = -(-r["n"] // shard_rows)
        cells.low[r["cell"]], cells.high[r["cell"]] = r["low"], r["high"]
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for c in enumerate(shards) for x in c]), F.col("cell").cast("int"))
    held = spark.sparkContext.broadcast(cells)

    def searched(visits: DataFrame) -> DataFrame:
        data = dealt.select("cell", F.pmod(F.xxhash64("id", "vec"), parts).cast("long").alias("part"), F.lit(False).alias("ask"), "id", "vec")
        ask = visits.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"), F.lit(True).alias("ask"), "id", "vec")
        rows = data.union(ask).select((F.col("cell") * (1 << 32) + F.col("part")).alias("shard"), "ask", "id", "vec").repartition("shard").sortWithinPartitions("shard", "ask", "id")
        got = rows.mapInPandas(_search(k, factor), "query_id long, ids array<long>, scores array<double>")
        return got.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    visit = "cell long, id long, vec array<double>"
    found = searched(queries.mapInPandas(_visits(held, factor, True), visit))
    if len(cells.bands) > 1:
        found = tables.written(best(found).drop("rank"), "home")
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asked = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "vec", "kth")
        found = found.union(searched(asked.mapInPandas(_visits(held, factor, False), visit)))
    return best(found).select("query_id", "rank", "vec_id", "score")
