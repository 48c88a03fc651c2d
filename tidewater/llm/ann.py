"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample, clusters that are too large being split again. Every row goes to the list of its
nearest centroid and, near a boundary, to further ones. Lists longer than a block are dealt to blocks. Queries find
their lists by a best-first walk on an in-memory graph of the centroids, taking every list whose distance is within a ratio
of the nearest one's. The ratio is fitted so that it covers the true neighbours of a bounded sample of queries. Largest
inner product becomes smallest distance by one more component that gives all vectors the same norm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, uniform
from tidewater.llm.vectors import lengths, matrix, usable
from tidewater.sources.shared import written

K = 20
#: Bounds of the fit: vectors the centroids are fitted on, queries the ratio is fitted on, centroids held in memory.
SAMPLE = 10_000
FIT_QUERIES = 128
CENTROIDS = 2048
LIST_ROWS = 200
#: A vector also goes to centroids within this ratio of its nearest one's distance, at most so many lists.
BOUNDARY = 1.04
REPLICAS = 3
#: Share of the fit queries' true neighbours whose lists the ratio must reach.
COVER = 0.985
LINKS = 12
BLOCK = 2000
CHUNK = 1 << 15


@dataclass
class Centroids:
    points: np.ndarray
    links: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, count: int, rounds: int = 8) -> Centroids:
        """k-means on unit vectors; then clusters of over twice the mean size are split in two until none is left."""
        rng = np.random.default_rng(8)
        points = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
        for _ in range(rounds):
            own = cls._nearest(sample, points)
            sums = np.zeros_like(points)
            np.add.at(sums, own, sample)
            sizes = np.bincount(own, minlength=len(points))
            points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
        most = max(4, 2 * len(sample) // max(1, len(points)))
        work, done = [sample[own == c] for c in range(len(points))], []
        while work:
            part = work.pop()
            halves = cls._halves(part, rng) if len(part) > most else None
            if halves:
                work += halves
            elif len(part):
                done.append(part.mean(axis=0))
        points = np.array(done)
        near = np.argsort(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) if len(points) <= 256 else -2 * points @ points.T + (points**2).sum(axis=1), axis=1)
        links = [set() for _ in points]
        for i, row in enumerate(near[:, 1 : LINKS + 1].tolist()):
            links[i].update(row)
            links[i].add((i + 1) % len(points))  # a ring keeps the graph in one piece
            for j in row:
                links[j].add(i)
        return cls(points, [np.array(sorted(x), np.int64) for x in links])

    @staticmethod
    def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        return ((points**2).sum(axis=1)[None, :] - 2 * rows @ points.T).argmin(axis=1)

    @classmethod
    def _halves(cls, part: np.ndarray, rng: np.random.Generator) -> list[np.ndarray] | None:
        pair = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            own = cls._nearest(part, pair)
            if not 0 < own.sum() < len(part):
                return None  # copies: the list is dealt to blocks instead
            pair = np.array([part[own == 0].mean(axis=0), part[own == 1].mean(axis=0)])
        return [part[own == 0], part[own == 1]]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        square = (rows**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * rows @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def search(self, query: np.ndarray, ratio: float, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Lists within ``ratio`` of the nearest, by best-first walk; it ends when all that is open is farther than that.

        If these lists hold fewer than ``need`` rows, going by ``held``, the nearest lists that hold as many come with them.
        """
        away = lambda which: np.sqrt(np.maximum(((self.points[which] - query) ** 2).sum(axis=1), 0))
        start = np.arange(0, len(self.points), max(1, len(self.points) // 8))
        seen = np.zeros(len(self.points), bool)
        seen[start] = True
        found = dict(zip(start.tolist(), away(start).tolist(), strict=True))
        open_ = [(d, c) for c, d in found.items()]
        heapq.heapify(open_)
        nearest, slack = min(found.values()), 8
        while open_:
            d, c = heapq.heappop(open_)
            if d > nearest * ratio:
                slack -= 1  # a few steps beyond, for a nearest one not met yet
                if slack < 0:
                    break
            fresh = self.links[c][~seen[self.links[c]]]
            if len(fresh):
                seen[fresh] = True
                for x, dx in zip(fresh.tolist(), away(fresh).tolist(), strict=True):
                    found[x] = dx
                    heapq.heappush(open_, (dx, x))
                    nearest = min(nearest, dx)
        lists = [c for c, d in found.items() if d <= nearest * ratio]
        if held is None or held[lists].sum() >= need:
            return lists
        order = np.argsort(away(np.arange(len(self.points))), kind="stable")
        nearer = order[: np.searchsorted(np.cumsum(held[order]), need) + 1]
        return sorted({*lists, *nearer.tolist()})


def _level(rows: np.ndarray, norm: float) -> np.ndarray:
    """Scaled to norm one at most, with one more component that makes it one exactly."""
    rows = rows / norm
    return np.hstack([rows, np.sqrt(np.maximum(0, 1 - (rows**2).sum(axis=1, keepdims=True)))])


def _toward(rows: np.ndarray) -> np.ndarray:
    """Queries as directions; their own norm does not change the order."""
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return np.hstack([rows, np.zeros((len(rows), 1))])


def top(scores: np.ndarray, asked: np.ndarray, vecs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best columns of each row, ties to the smaller id; -inf stays.

    A matrix product may round equal vectors apart, so columns as good as the k-th within rounding are scored anew, in
    one order of summation, before the cut.
    """
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    by_id = np.argsort(ids, kind="stable")
    each = np.maximum.reduceat(scores[:, by_id], np.unique(ids[by_id], return_index=True)[1], axis=1)
    last = min(k, each.shape[1]) - 1
    kth = -np.partition(-each, last, axis=1)[:, last]
    slack = 1e-12 * np.sqrt((asked**2).sum(axis=1) * (vecs**2).sum(axis=1).max())
    at, column = np.nonzero((scores >= (kth - slack)[:, None]) & (scores > -np.inf))
    score = np.concatenate([(asked[at[i : i + CHUNK]] * vecs[column[i : i + CHUNK]]).sum(axis=1) for i in range(0, max(1, len(at)), CHUNK)])
    order = np.lexsort((ids[column], -score, at))
    at, column, score = at[order], column[order], score[order]
    # rows of equal ids count as one: only the best of each goes on
    _, first = np.unique(np.stack([at, ids[column]]), axis=1, return_index=True)
    first.sort()
    at, column, score = at[first], column[first], score[first]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], column[rank < k], score[rank < k]


def exact_neighbours(rows: DataFrame, queries: list, k: int = K) -> DataFrame:
    """``query_id, vec_id, score`` of a bounded list of query rows by comparison with every row, in blocks."""
    ids, vecs = np.array([q["vec_id"] for q in queries], np.int64), np.array([q["v"] for q in queries], np.float64)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part) or not len(ids):
                continue
            own = part["vec_id"].to_numpy()
            scores = vecs @ matrix(part["v"]).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            at, best, score = top(scores, vecs, matrix(part["v"]), own, k)
            yield pd.DataFrame({"query_id": ids[at], "vec_id": own[best], "score": score})

    return _best(rows.mapInPandas(compare, "query_id long, vec_id long, score double").where("score > double('-infinity')"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def search(table: DataFrame, queries: Column, vec_id: str = "vec_id", vec: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``queries`` holds, the k rows found with the largest inner products.

    All usable rows are indexed and are candidates, a query's own id excepted; ties go to the smaller id. Rows with a null
    id, or vectors that are null, zero or non-finite in a component, take no part; vectors of several lengths are searched among those of their own, one index a length.
    Fewer candidates than k give fewer rows, none give none. Rows with equal ids count as one.
    """
    bound_batches(table.sparkSession)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"), queries.alias("q")).where(usable("v") & F.col("vec_id").isNotNull())
    out = None
    for dim in lengths(rows, "v") or [0]:
        found = _search(written(rows.where(F.size("v") == dim), "rows"), k)
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, k: int) -> DataFrame:
    """The search among rows ``vec_id, v, q`` of one length."""
    spark = rows.sparkSession
    totals = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n = totals["n"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    norm = float(np.sqrt(totals["m"]))
    sample = rows.where(uniform("vec_id", seed=8) < SAMPLE / n).select("v").collect() or rows.select("v").limit(SAMPLE).collect()
    centroids = Centroids.fit(_level(np.array([r["v"] for r in sample], np.float64), norm), min(CENTROIDS, max(1, n // LIST_ROWS), len(sample)))
    sent = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def lists_of(vecs: pd.Series) -> pd.Series:
        away = sent.value.distances(_level(matrix(vecs), norm))
        order = np.argsort(away, axis=1)[:, :REPLICAS]
        near = np.take_along_axis(away, order, axis=1)
        return pd.Series([o[d <= d[0] * BOUNDARY + 1e-12].astype(np.int32) for o, d in zip(order, near, strict=True)])

    postings = written(rows.select("vec_id", "v", F.posexplode(lists_of("v")).alias("pos", "list")), "postings")
    blocks = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    ratio = _ratio(rows, postings, centroids, n, k)
    held_in = np.zeros(len(centroids.points), np.int64)  # each id once, in its nearest list, so that replicas don't count
    for r in postings.where("pos = 0").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect():
        held_in[r["list"]] = r["n"]

    @F.pandas_udf("array<int>")
    def lists_for(vecs: pd.Series) -> pd.Series:
        return pd.Series([np.array(sent.value.search(q, ratio, held_in, k + 1), np.int32) for q in _toward(matrix(vecs))])

    parts = int(max(1, np.ceil(n * REPLICAS / 10_000)))
    key = F.pmod(F.xxhash64("list", "block"), F.lit(parts)).alias("part")
    asked = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.explode(lists_for("v")).alias("list"))
    asked = asked.join(blocks, "list").select("query_id", "qv", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.select("query_id", "qv", "list", "block", key)
    held = postings.join(blocks, "list").select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")).select("*", key)

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            vecs, ids = matrix(mine["v"]), mine["vec_id"].to_numpy()
            index = mine.reset_index(drop=True).groupby(["list", "block"]).indices
            theirs = theirs.reset_index(drop=True)
            first = theirs.drop_duplicates("query_id")
            places = dict(zip(first["query_id"], range(len(first)), strict=True))
            points = matrix(first["qv"])
            for place, at in theirs.groupby(["list", "block"]).indices.items():
                if place not in index:
                    continue
                own = index[place]
                who = theirs["query_id"].to_numpy()[at]
                scores = points[[places[q] for q in who]] @ vecs[own].T
                scores[who[:, None] == ids[own][None, :]] = -np.inf
                rows_, best, score = top(scores, points[[places[q] for q in who]], vecs[own], ids[own], k)
                out.append(pd.DataFrame({"query_id": who[rows_], "vec_id": ids[own][best], "score": score}))
        if not out:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        found = pd.concat(out).drop_duplicates(["query_id", "vec_id"])
        found = found[found["score"] > -np.inf].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    found = held.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(compare, "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ratio(rows: DataFrame, postings: DataFrame, centroids: Centroids, n: int, k: int) -> float:
    """The distance ratio that reaches a list of COVER of the true neighbours of at most about FIT_QUERIES rows."""
    some = rows.where(uniform("vec_id", seed=9) < FIT_QUERIES / n).select("vec_id", "v").distinct().collect()
    if not some:
        return 2.0
    exact = exact_neighbours(rows.select("vec_id", "v"), some, k)
    pairs = exact.join(postings.select("vec_id", "list"), "vec_id").groupBy("query_id", "vec_id").agg(F.collect_list("list").alias("lists")).collect()
    away = dict(zip([r["vec_id"] for r in some], centroids.distances(_toward(np.array([r["v"] for r in some], np.float64))), strict=True))
    needed = [min(away[p["query_id"]][c] for c in p["lists"]) / max(away[p["query_id"]].min(), 1e-12) for p in pairs]
    return float(np.quantile(needed, COVER)) * 1.0001 + 1e-9 if needed else 2.0
