"""Embedding near-duplicates by NN-descent.

Each distinct vector keeps a list of its nearest neighbours found so far. Lists start from blocks of vectors on the same side
of random hyperplanes; then each vector's neighbours and those whose neighbour it is are compared with each other
(neighbours of neighbours), until lists stop improving. Edges at or above the threshold are kept and joined to components. A list that is
full of such edges is saturated, and may hide links to vectors outside its component: saturated vectors get a second list,
of neighbours in other components only, until no such list adds a link; and every list is enlarged to its whole component,
compared block by block, which gives every link. Recall is audited against all rows for a bounded sample of vectors; descent
goes on while the audit finds a miss, and an audited recall below RECALL in the end is an error. The audit adds no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, uniform
from tidewater.llm.vectors import groups, lengths, matrix, usable
from tidewater.operators.graph import connected_components
from tidewater.sources.shared import written

THRESHOLD = 0.95
NEIGHBOURS = 10
TREES = 8
#: Vectors compared with each other in one block, and how many a first block has about.
BLOCK = 256
LEAF = 128
ROUNDS = 3
#: Vectors of one audit, the bound on what is sent to every executor, and most audits with a round of descent between.
AUDIT = 512
AUDITS = 4
#: Share of the audited links that the result must hold.
RECALL = 0.9
SEED = 5
_LIST = "id long, near array<struct<s:double,n:long>>"


def _top(group: pd.DataFrame, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """The best k of a block for each of its vectors: above its ``worst`` and in another ``component``, where it has these."""
    ids, vecs = group["id"].to_numpy(), matrix(group["vec"])
    sims = vecs @ vecs.T
    if "component" in group:
        own = group["component"].to_numpy()
        sims[own[:, None] == own[None, :]] = -2.0
    np.fill_diagonal(sims, -2.0)
    floor = group["worst"].to_numpy() if "worst" in group else np.full(len(ids), -2.0)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    for i, row in enumerate(best.tolist()):
        near = [(float(sims[i, j]), int(ids[j])) for j in row if sims[i, j] > floor[i]]
        if near:
            yield int(ids[i]), near


def _compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lists from blocks of ``id, vec`` and what else `_top` reads; a block has equal ``keys``."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for group in groups(parts, keys):
            found += _top(group, NEIGHBOURS)
            if len(found) > 5000:
                yield pd.DataFrame(found, columns=["id", "near"])
                found = []
        yield pd.DataFrame(found, columns=["id", "near"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, _LIST)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the best k for each id. Entries are ranked as rows, so that an id named by any number of lists fits."""
    entries = lists.select("id", F.explode("near").alias("x")).select("id", "x.s", "x.n").repartition("id")
    entries = entries.groupBy("id", "n").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), F.desc("n")))
    best = entries.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", "n")), asc=False).alias("near"))


def _salted(rows: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    """``rows`` with ``salt``: groups of more than ``size`` are dealt to as many blocks as they need, none dropped.

    The deal depends on the keys too, so that members apart in one group can meet in the next.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(counts, keys).withColumn("salt", F.pmod(F.xxhash64(member, *keys), F.col("blocks"))).drop("blocks")


def first_lists(vectors: DataFrame, n: int, dim: int, seed: int = SEED) -> DataFrame:
    """Neighbours within blocks of vectors that share the signs of random projections, for several draws of these.

    ``vectors`` has ``id, vec`` and may have ``component``: then only vectors of other components are neighbours.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    planes = np.random.default_rng(seed).normal(size=(dim, TREES * max(1, bits)))

    @F.pandas_udf("array<long>")
    def sides(vecs: pd.Series) -> pd.Series:
        over = (matrix(vecs) @ planes > 0).reshape(len(vecs), TREES, -1)[:, :, :bits]
        codes = (over * (1 << np.arange(bits))).sum(axis=2) if bits else np.zeros((len(vecs), TREES), np.int64)
        return pd.Series(list(codes.astype(np.int64)))

    coded = vectors.select("*", F.posexplode(sides("vec")).alias("tree", "side"))
    return _merged(_compared(_salted(coded, ["tree", "side"], "id", BLOCK), ["tree", "side", "salt"]), NEIGHBOURS)


def descend(lists: DataFrame, vectors: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """One round: around each vector, its neighbours both ways are compared and better ones enter the lists.

    ``through`` gives further lists whose neighbours are compared; ``vectors`` may have ``component`` as in `first_lists`.
    """
    edges = (lists if through is None else lists.unionByName(through)).select(F.col("id").alias("w"), F.explode("near.n").alias("id"))
    around = edges.unionByName(edges.select(F.col("id").alias("w"), F.col("w").alias("id"))).distinct()
    around = _salted(around, ["w"], "id", BLOCK // 4)
    full = F.size("near") >= NEIGHBOURS
    worst = lists.select("id", F.when(full, F.element_at("near", -1)["s"]).otherwise(-2.0).alias("worst"))
    known = vectors.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    return _merged(lists.unionByName(_compared(around.join(known, "id"), ["w", "salt"])), NEIGHBOURS)


def _links(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.select(F.col("id").alias("a"), F.explode("near").alias("x")).where(F.col("x.s") >= threshold).select("a", F.col("x.n").alias("b"))


def joined(lists: DataFrame, vectors: DataFrame, dim: int, threshold: float, seed: int = SEED) -> DataFrame:
    """``node, component`` by the links of the lists and by those that saturated lists have no room for.

    Such a link has a saturated list at both ends (else it would be in one of them), so saturated vectors alone look for
    neighbours in other components, by blocks and then around their own neighbours. Each link found joins components, and
    the search starts again from the new ones until it finds none.
    """
    edges = _links(lists, threshold)
    component = written(connected_components(edges), "components")
    saturated = written(lists.where((F.size("near") >= NEIGHBOURS) & (F.element_at("near", -1)["s"] >= threshold)), "saturated")
    while True:
        some = saturated.select("id").join(component.withColumnRenamed("node", "id"), "id").join(vectors, "id")
        size = some.agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).first()
        if size["a"] == size["b"]:
            return component
        outer = written(first_lists(some, size["n"], dim, seed), "outer")
        outer = written(descend(outer, some, saturated), "outer")
        fresh = _links(outer, threshold)
        if fresh.isEmpty():
            return component
        # whole components are joined by their smallest nodes: the stars found so far stand for all links inside
        stars = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        component = written(connected_components(stars.unionByName(fresh)), "components")
        seed += 1


def audit(vectors: DataFrame, n: int, threshold: float, seed: int = SEED) -> DataFrame:
    """All links ``(a, b)`` of at most about AUDIT sampled vectors, by comparison with every vector, in blocks."""
    sample = vectors.where(uniform("id", seed=seed) < AUDIT / max(1, n)).collect()
    ids, vecs = np.array([r["id"] for r in sample], np.int64), np.array([r["vec"] for r in sample], np.float64)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part) and len(ids):
                i, j = np.nonzero(matrix(part["vec"]) @ vecs.T >= threshold)
                own = part["id"].to_numpy()[i]
                yield pd.DataFrame({"a": own, "b": ids[j]})[own != ids[j]]

    return vectors.mapInPandas(compare, "a long, b long")


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links`` within components, every pair of vectors of one component compared once, block by block.

    ``members`` has ``component, id, vec, copies``. A component of more than BLOCK vectors is dealt to blocks, and each
    block meets each other in a task of its own, so that no task holds a whole component.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "vec", "copies"
    )

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(parts, ["component", "p", "q"]):
            left, right = group[group["own"] == group["p"].iloc[0]], group[group["own"] == group["q"].iloc[0]]
            if not len(left) or not len(right):
                continue
            near = matrix(left["vec"]) @ matrix(right["vec"]).T >= threshold
            if group["p"].iloc[0] == group["q"].iloc[0]:
                np.fill_diagonal(near, False)
                yield pd.DataFrame({"id": left["id"].to_numpy(), "links": near @ right["copies"].to_numpy()})
            else:
                yield pd.DataFrame({"id": left["id"].to_numpy(), "links": near @ right["copies"].to_numpy()})
                yield pd.DataFrame({"id": right["id"].to_numpy(), "links": left["copies"].to_numpy() @ near})

    keys = ["component", "p", "q"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "id long, links long")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Equal vectors are collapsed first and counted as linked with each other. Vectors that are null, zero, or hold null or
    non-finite components, and rows with a null id, link with nothing (a null id has a null component). Vectors of several lengths are
    compared with those of their own, one run a length. Repeated rows count as linked copies and give repeated rows. An empty table gives no rows.
    """
    bound_batches(rows.sparkSession)
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v"), (usable(vec) & F.col(vec_id).isNotNull()).alias("ok"))
    base = base.select("vec_id", F.when(F.col("ok"), F.col("v")).alias("v"))
    found = base.where("v is not null")
    named = None
    for dim in lengths(found, "v") or [0]:
        own = _classes(found.where(F.size("v") == dim), dim, threshold, rounds)
        named = own if named is None else named.unionByName(own)
    out = base.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _classes(rows: DataFrame, dim: int, threshold: float, rounds: int) -> DataFrame:
    """``v, component_id, n_links`` of each distinct vector among rows ``vec_id, v`` of one length."""
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))

    @F.pandas_udf("array<double>")
    def unit(vecs: pd.Series) -> pd.Series:
        x = matrix(vecs)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return pd.Series(list(x / np.linalg.norm(x, axis=1, keepdims=True)))

    classes = written(classes.select("id", "copies", "v", unit("v").alias("vec")), "vectors")
    vectors = classes.select("id", "vec")
    n = classes.count()
    lists = written(first_lists(vectors, n, dim), "lists")
    total = F.sum(F.aggregate("near", F.lit(0.0), lambda a, x: a + x["s"])).alias("s")
    now = lists.agg(total).first()["s"] or 0.0
    for _ in range(rounds):
        before = now
        lists = written(descend(lists, vectors), "lists")
        now = lists.agg(total).first()["s"] or 0.0
        if now - before <= 1e-3 * max(1, n):
            break
    for at in range(AUDITS):
        component = joined(lists, vectors, dim, threshold, SEED + 100 * at)
        checked = written(audit(vectors, n, threshold, SEED + at), "audit")
        ends = checked.join(component.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
        ends = ends.join(component.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
        seen = ends.agg(F.count("*").alias("n"), F.count_if(F.expr("x = y")).alias("found")).first()
        if seen["found"] == seen["n"]:
            break
        if at + 1 < AUDITS:
            lists = written(descend(lists, vectors), "lists")
        elif seen["found"] < RECALL * seen["n"]:
            raise RuntimeError(f"{seen['found']} of {seen['n']} audited links found after {AUDITS} audits")
    members = component.join(classes, F.col("node") == F.col("id")).select("component", "id", "vec", "copies")
    links = link_counts(members, threshold)
    return classes.join(component, F.col("node") == F.col("id"), "left").join(links, "id", "left").select(
        "v", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
