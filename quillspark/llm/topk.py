"""Exact top-k by dual-tree search over cover trees.

Queries and data are indexed alike: a cover tree whose nodes cover all their vectors by an exact radius about a centre
of their own and have children within a smaller radius, about centres that lie farther apart than that radius. Pairs
of a query node and a data node go down both trees together; a pair is pruned when the largest inner product that
centres and covering radii allow is below the worst kth score of all queries in the query node. Pairs of leaves that
remain are scored by matrix products, the most promising first.

The same rule holds between blocks: rows are dealt to cells by their nearest pivot, each cell has its covering radius
for queries and for data, and after the queries have been held against their own cells, a pair of cells is left out
where its bound is below the worst kth score of the cell's queries. Cells are cut into blocks of bounded size, and each
pair of blocks is one task's work, so memory depends on the block sizes alone.

Vectors take part as integers floor(scale * x), so scores are exact.

Edge cases: a vector that is null, empty or holds null, NaN or infinite components takes no part, as query or as
candidate, nor does a row without id; vectors of unequal length compare as if filled up with zeros; equal scores go
to the smaller id; repeated rows of an id other than the query's own count once each; a query with fewer than k
candidates has all of them, one with none has no row; an empty table gives an empty result; extra columns are ignored.
Exact while sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Pivots are at most so many, whatever the input; larger cells are cut into more blocks.
MOST_PIVOTS = 256


class CoverTree:
    """Nodes in arrays of one slot a node, parents before children; `order` holds the rows so that each node's rows lie
    side by side, from `first` to `last`; the children of a node are numbered in a row, leaves have none.

    A node's rows lie within `reach` of one of them, its seed; its children have seeds that lie farther apart than
    reach / base, and cover their own rows within that distance. The bound uses the middle of the rows and the exact
    radius about it, which is never looser than the seed's by much and mostly far tighter."""

    def __init__(self, points: np.ndarray, leaf: int = 16, base: float = 1.1):
        self.points, self.order = points, np.arange(len(points))
        middle = points.mean(0) if len(points) else np.zeros(points.shape[1])
        seeds = [int(((points - middle) ** 2).sum(1).argmin()) if len(points) else -1]
        self.first, self.last, self.parent, self.child, self.children = [0], [len(points)], [-1], [0], [0]
        centres, radii, reaches, at = [], [], [], 0
        while at < len(self.first):
            lo, hi = self.first[at], self.last[at]
            rows = self.order[lo:hi].copy()
            own = points[rows]
            centres.append(own.mean(0) if len(rows) else middle)
            radii.append(float(np.sqrt(((own - centres[at]) ** 2).sum(1).max(initial=0.0))))
            reaches.append(float(np.sqrt(((own - points[seeds[at]]) ** 2).sum(1).max(initial=0.0))) if len(rows) else 0.0)
            if hi - lo > leaf and reaches[at] > 0:
                self.child[at] = len(self.first)
                for group, seed in self._cover(points, rows, seeds[at], reaches[at] / base):
                    self.order[lo : lo + len(group)] = group
                    self.first.append(lo)
                    self.last.append(lo + len(group))
                    self.parent.append(at)
                    self.child.append(0)
                    self.children.append(0)
                    self.children[at] += 1
                    seeds.append(seed)
                    lo += len(group)
            at += 1
        self.first, self.last, self.parent, self.child, self.children = (np.array(x) for x in (self.first, self.last, self.parent, self.child, self.children))
        self.centre, self.radius, self.reach, self.seed = np.array(centres), np.array(radii), np.array(reaches), np.array(seeds)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.is_leaf = self.children == 0

    @staticmethod
    def _cover(points: np.ndarray, rows: np.ndarray, seed: int, radius: float) -> Iterator[tuple[np.ndarray, int]]:
        """Groups within `radius` of seeds that lie farther apart than that, the given one first. The farthest row is
        never in the first group, so there are two at least."""
        while len(rows):
            near = ((points[rows] - points[seed]) ** 2).sum(1) <= radius * radius
            yield rows[near], seed
            rows = rows[~near]
            seed = int(rows[0]) if len(rows) else -1

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each node's rows."""
        out = np.full(len(self.first), np.inf)
        leaves = np.flatnonzero(self.is_leaf)
        by_place = np.argsort(self.first[leaves], kind="stable")
        leaves = leaves[by_place]
        out[leaves] = np.minimum.reduceat(values[self.order], self.first[leaves])
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] = min(out[self.parent[node]], out[node])
        return out


class DualSearch:
    """`tested`, `pruned` and `scored` count node pairs: held against the bound, cut off by it, scored as leaves;
    `products` counts the inner products that were taken."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray | None = None):
        self.q, self.d, self.k = CoverTree(queries, 4), CoverTree(data, 32), k
        self.query_ids, self.ids = query_ids, ids
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.known = np.full(len(queries), -np.inf) if known is None else known
        self.tested = self.pruned = self.scored = self.products = 0

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products between pairs of nodes."""
        q, d = self.q, self.d
        bound = self.middle[a, b] + q.radius[a] * d.norm[b] + d.radius[b] * q.norm[a] + q.radius[a] * d.radius[b]
        return bound + 1e-9 * (q.norm[a] + q.radius[a]) * (d.norm[b] + d.radius[b]) + 1e-6

    def worst(self) -> np.ndarray:
        """For each query node, the worst kth score of its queries."""
        return self.q.least(np.maximum(self.scores[:, -1], self.known))

    def run(self) -> None:
        if not len(self.scores) or not len(self.ids):
            return
        q, d = self.q, self.d
        with np.errstate(all="ignore"):
            self.middle = q.centre @ d.centre.T
            # A first look: each query leaf against the data leaves whose centres promise most.
            leaves_q, leaves_d = np.flatnonzero(q.is_leaf), np.flatnonzero(d.is_leaf)
            done = np.zeros((len(q.first), len(d.first)), bool)
            look = min(len(leaves_d), 1 + self.k)
            for a in leaves_q.tolist():
                some = leaves_d[np.argpartition(-self.middle[a, leaves_d], look - 1)[:look]]
                self.score(a, some)
                done[a, some] = True
            # Both trees together, level by level.
            worst = self.worst()
            a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
            ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(a):
                bound = self.most(a, b)
                keep = ~(bound < worst[a])
                self.tested += len(a)
                self.pruned += int((~keep).sum())
                a, b, bound = a[keep], b[keep], bound[keep]
                end = q.is_leaf[a] & d.is_leaf[b]
                ends.append((a[end], b[end], bound[end]))
                a, b = a[~end], b[~end]
                by_query = d.is_leaf[b] | (~q.is_leaf[a] & (q.radius[a] >= d.radius[b]))
                n = np.where(by_query, q.children[a], d.children[b])
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                by_query, a, b = (np.repeat(x, n) for x in (by_query, a, b))
                a, b = np.where(by_query, q.child[a] + step, a), np.where(by_query, b, d.child[b] + step)
            a, b, bound = (np.concatenate(x) for x in zip(*ends, strict=True))
            fresh = ~done[a, b]
            a, b, bound = a[fresh], b[fresh], bound[fresh]
            order = np.lexsort((-bound, a))
            a, b, bound = a[order], b[order], bound[order]
            edge = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                leaf, own = a[lo], q.order[q.first[a[lo]] : q.last[a[lo]]]
                while lo < hi:
                    least = np.maximum(self.scores[own, -1], self.known[own]).min()
                    upto = lo + int(np.searchsorted(-bound[lo:hi], -least, "right")) if least > -np.inf else hi
                    if upto <= lo:
                        self.pruned += hi - lo
                        break
                    upto = min(upto, lo + 512)
                    self.score(leaf, b[lo:upto])
                    lo = upto

    def score(self, a: int, leaves: np.ndarray) -> None:
        """One query leaf against some data leaves."""
        self.scored += len(leaves)
        rows = self.q.order[self.q.first[a] : self.q.last[a]]
        n = self.d.last[leaves] - self.d.first[leaves]
        own = self.d.order[np.arange(int(n.sum())) + np.repeat(self.d.first[leaves] - np.cumsum(n) + n, n)]
        got = self.q.points[rows] @ self.d.points[own].T
        self.products += got.size
        ids = self.ids[own]
        got[self.query_ids[rows][:, None] == ids[None, :]] = -np.inf
        least = -np.partition(-got, self.k - 1, axis=1)[:, self.k - 1] if got.shape[1] > self.k else np.full(len(rows), -np.inf)
        least = np.maximum(least, np.maximum(self.scores[rows, -1], self.known[rows]))
        row, col = np.nonzero((got >= least[:, None]) & (got > -np.inf))
        score = np.concatenate([self.scores[rows].ravel(), got[row, col]])
        found = np.concatenate([self.found[rows].ravel(), ids[col]])
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), row])
        order = np.lexsort((found, -score, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        take = order[first[:, None] + np.arange(self.k)]
        self.scores[rows], self.found[rows] = score[take], found[take]


def integer_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad & (F.size(wide) > 0), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def _matrix(vectors: pd.Series | list, width: int) -> np.ndarray:
    lens = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors) and (lens == width).all():
        return np.stack(list(vectors)).astype(float)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _deal(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their nearest pivot and the distance to it."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = _matrix(pdf["vector"], pivots.shape[1])
            cell = np.argmax(m @ pivots.T - (pivots**2).sum(1) / 2, axis=1)
            yield pdf.assign(cell=cell.astype("int32"), far=np.sqrt(((m - pivots[cell]) ** 2).sum(1)))

    return rows.mapInPandas(run, "vec_id bigint, vector array<double>, asked boolean, cell int, far double")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, query_block: int = 2_048, data_block: int = 8_192) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest scores among all rows but its own."""
    spark, space = df.sparkSession, Workspace(df.sparkSession, "topk")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), integer_vectors(F.col(f"`{vector_col}`"), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id is not null and vector is not null")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width, count = sizes.width or 1, min(max(1, -(-sizes.n // data_block)), MOST_PIVOTS)
    some = rows.select("vec_id", "vector").orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(count).select("vector").collect()
    pivots = np.unique(_matrix([r.vector for r in some], width), axis=0) if some else np.zeros((1, width))
    dealt = space.put(_deal(rows, pivots).withColumn("place", F.monotonically_increasing_id()), "dealt")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max("far").alias("far"), F.max(F.when(F.col("asked"), F.col("far"))).alias("far_q")).collect()
    blocks = {r.cell: -(-r.n // data_block) for r in cells}
    asked = [r.cell for r in cells if r.q]
    query_blocks = max(1, -(-sum(r.q for r in cells) // query_block))
    first = dict(zip(blocks, (np.cumsum([*blocks.values()]) - [*blocks.values()]).tolist(), strict=True))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        s = DualSearch(_matrix(left["vector"], width), left["vec_id"].to_numpy(), _matrix(right["vector"], width), right["vec_id"].to_numpy(), k, left["known"].to_numpy(float))
        s.run()
        ok = np.isfinite(s.scores)
        at = np.nonzero(ok)[0]
        return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[at], "vec_id": s.found[ok], "score": s.scores[ok].astype("int64")})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(pairs: list[tuple[int, int]], known: DataFrame | None) -> DataFrame:
        """The k best of the queries of one cell among the data of another, over pairs of cells. Blocks of queries are
        made across cells, so that each block of data meets as few of them as there are; a query goes to the blocks of
        its own pairs alone."""
        to = F.broadcast(spark.createDataFrame([(c, first[e], blocks[e]) for c, e in pairs], "c int, first_d int, n_d int"))
        held = F.broadcast(spark.createDataFrame([(e, first[e], blocks[e]) for e in sorted({e for _, e in pairs})], "e int, first_d int, n_d int"))
        queries = space.get("dealt").where("asked").select("vec_id", "vector", "cell").dropDuplicates(["vec_id", "vector"])
        queries = queries.withColumn("known", F.lit(float("-inf"))) if known is None else queries.join(known, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
        left = queries.join(to, F.col("cell") == F.col("c")).select("vec_id", "vector", "known", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.col("first_d"), F.col("first_d") + F.col("n_d") - 1)).alias("d"))
        right = space.get("dealt").join(held, F.col("cell") == F.col("e")).select("vec_id", "vector", (F.col("first_d") + F.pmod(F.xxhash64("place"), F.col("n_d"))).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
        got = left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
        return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")

    own = best([(c, c) for c in asked], None)
    if len(blocks) > 1 and asked:
        own = space.put(own, "own")
        kth = own.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("known")).where("known is not null").withColumnRenamed("query_id", "vec_id")
        queries = dealt.where("asked").select("vec_id", "cell").distinct()
        least = {r.cell: r.least for r in queries.join(kth, "vec_id", "left").groupBy("cell").agg(F.min(F.coalesce("known", F.lit(float("-inf")))).alias("least")).collect()}
        rest = [(c, e) for c, e in cell_pairs(pivots, {r.cell: r.far_q for r in cells if r.q}, {r.cell: r.far for r in cells}, least) if c != e]
        if rest:
            own = own.unionByName(best(rest, kth))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cell_pairs(pivots: np.ndarray, far_q: dict[int, float], far: dict[int, float], least: dict[int, float]) -> list[tuple[int, int]]:
    """Pairs of a cell of queries and a cell of data that may hold one of the k best: the same bound as between nodes."""
    norm = np.sqrt((pivots**2).sum(1))
    out = []
    for c, rq in far_q.items():
        for e, rd in far.items():
            bound = pivots[c] @ pivots[e] + rq * norm[e] + rd * norm[c] + rq * rd + 1e-9 * (norm[c] + rq) * (norm[e] + rd) + 1e-6
            if not bound < least.get(c, -np.inf):
                out.append((c, e))
    return out
