"""Lexical retrieval packing: windows filled with documents that a BM25 index finds near their seed.

Documents are tokenized once into a written table. Document frequencies of token ids are counted over all of it; the table
of them is bounded by the vocabulary. The index is sharded by content: a tree of halving hyperplanes over projected BM25 vectors,
fitted on a bounded sample, gives every document a leaf, and documents are sorted by leaf before they are cut into shards, so that a
shard holds documents from the whole corpus that share terms. Each task holds one shard's inverted index at a time, and fills
the shard's windows. A seed retrieves its best unused neighbours, which fill its window in order; the one that does not fit is
cut, and its rest seeds the next window. The last window of a shard is cut into sequences whose lengths are powers of two,
so nothing is padded there.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, release, uniform
from tidewater.sources.shared import written

WINDOW = 4096
#: Appended to every document.
END_ID = 2
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 4000
#: Weightiest terms of a seed that other documents of the shard have, and neighbours fetched at a time.
QUERY_TERMS = 32
FETCH = 16
#: Documents that the tree is fitted on, tokens of each that count there, and sampled documents below which a node is not fitted.
SAMPLE = 6000
SAMPLE_TOKENS = 4096
NODE_SAMPLE = 24
#: Documents of a leaf, about; leaves grow in number with the corpus. Dimensions of the projection.
LEAF_DOCS = 2000
DIMENSIONS = 32
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batches(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` tokens together."""
    low = 0
    while low < len(sizes):
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), most, side="right")))
        yield low, high
        low = high


def _term_counts(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, token id, times)`` of each distinct token of each document, by row."""
    pairs, counts = np.unique((np.repeat(np.arange(len(ids)), sizes) << 32) | np.concatenate(ids).astype(np.int64), return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, counts


class Leaves:
    """A binary tree over BM25 vectors, projected at random to few dimensions.

    Nodes with enough sampled documents are halved at the median along their main axis. Further levels cut along fixed random
    axes at the mean of the last fitted node, so the number of leaves is not bound by the sample.
    """

    def __init__(self, sample: list[np.ndarray], docs: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, docs / LEAF_DOCS)))))
        self.fitted = min(self.depth, max(0, int(np.log2(max(1, len(sample) / NODE_SAMPLE)))))
        if not self.depth:
            return
        here = [np.unique(x) for x in sample]
        df = np.bincount(np.concatenate([*here, np.zeros(1, np.int64)]).astype(np.int64))
        self.idf = np.log1p((len(sample) - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, float(np.mean([len(x) for x in sample]))) if sample else 1.0
        self.planes = rng.normal(size=(len(df), DIMENSIONS)).astype(np.float32)
        self.axes = rng.normal(size=(self.depth, DIMENSIONS)).astype(np.float32)
        vectors = self.vectors(sample)
        self.normals = np.zeros((1 << self.fitted, DIMENSIONS), np.float32)
        self.cuts = np.zeros(1 << self.fitted, np.float32)
        self.centres = np.zeros((1 << self.fitted, DIMENSIONS), np.float32)
        rows = {1: np.arange(len(vectors))}
        for node in range(1, 1 << self.fitted):  # as in a heap: 2 n and 2 n + 1 below n
            own = vectors[rows[node]]
            if len(own) > 1:
                self.normals[node] = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)[2][0]
            along = own @ self.normals[node]
            self.cuts[node] = np.median(along) if len(own) else 0
            rows[2 * node], rows[2 * node + 1] = rows[node][along <= self.cuts[node]], rows[node][along > self.cuts[node]]
        for i in range(1 << self.fitted):
            own = vectors[rows[(1 << self.fitted) + i]] if len(vectors) else vectors
            self.centres[i] = own.mean(axis=0) if len(own) else 0

    def vectors(self, ids: list[np.ndarray]) -> np.ndarray:
        """Projected BM25 vectors of length one; tokens that the sample lacks have no part."""
        out = np.zeros((len(ids), DIMENSIONS), np.float32)
        sizes = np.array([len(x) for x in ids], np.int64)
        for low, high in _batches(sizes):
            rows, terms, n = _term_counts(ids[low:high], sizes[low:high])
            seen = terms < len(self.idf)
            rows, terms, n = rows[seen], terms[seen], n[seen].astype(np.float32)
            impact = self.idf[terms] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[low + rows].astype(np.float32) / np.float32(self.mean)))
            there, first = np.unique(rows, return_index=True)
            if len(there):
                norms = np.sqrt(np.add.reduceat(impact**2, first))
                out[low + there] = np.add.reduceat(impact[:, None] * self.planes[terms], first, axis=0) / np.maximum(norms, 1e-9)[:, None]
        return out

    def of(self, ids: list[np.ndarray]) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(ids), np.int64)
        vectors, node = self.vectors(ids), np.ones(len(ids), np.int64)
        for _ in range(self.fitted):
            node = 2 * node + ((vectors * self.normals[node]).sum(axis=1) > self.cuts[node])
        leaf = node - (1 << self.fitted)
        rest = vectors - self.centres[leaf]
        for level in range(self.fitted, self.depth):
            leaf = 2 * leaf + (rest @ self.axes[level] > 0)
        return leaf


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds all ids of the tokenizer."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    most = max([END_ID, *model["model"]["vocab"].values(), *[t["id"] for t in model["added_tokens"]]])
    return "<u2" if most < 1 << 16 else "<u4"


def _encoded(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    bpe, end = _tokenizer(path), np.array([END_ID], "<u4").tobytes()
    for at in range(0, len(texts), 256):
        for ids in bpe.encode(texts[at : at + 256]):
            yield np.frombuffer(ids + end, "<u4")


def fit_leaves(docs: DataFrame, path: str, text: str = "text") -> Leaves:
    """The tree, from about SAMPLE documents drawn by a hash of their text, SAMPLE_TOKENS tokens of each."""
    n = docs.count()
    if n <= LEAF_DOCS:
        return Leaves([], n)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([x[:SAMPLE_TOKENS].tobytes() for x in _encoded(list(texts), path)])

    drawn = docs.select(F.col(text).alias("t")).where(uniform(F.md5(F.coalesce(F.col("t"), F.lit(""))), seed=3) < SAMPLE / n).distinct()
    drawn = drawn.orderBy(F.md5(F.coalesce(F.col("t"), F.lit("")))).limit(2 * SAMPLE).select(encode("t").alias("ids"))
    return Leaves([np.frombuffer(r["ids"], "<u4") for r in drawn.collect()], n)


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, leaf`` with ids of the type ``id_type`` gives, END_ID last; null text is empty."""
    bound_batches(docs.sparkSession)
    kind = id_type(path)
    leaves = docs.sparkSession.sparkContext.broadcast(fit_leaves(docs, path, text))

    @F.pandas_udf("ids binary, leaf long")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for texts in parts:
            ids = list(_encoded(list(texts), path))
            yield pd.DataFrame({"ids": [x.astype(kind).tobytes() for x in ids], "leaf": leaves.value.of(ids)})
        release()

    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), encode(F.col(text)).alias("t")).select("doc_id", "t.ids", "t.leaf"), "tokens")


def by_content(tokens: DataFrame) -> DataFrame:
    """``tokens`` sorted by leaf within partitions, in an order that reruns repeat; leaves of far more rows than others are dealt to several."""
    large = tokens.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * LEAF_DOCS)).alias("parts")).where("parts > 1")
    large = written(large, "leaves")
    rows = tokens.withColumn("x", F.xxhash64("ids")).join(large, "leaf", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "x"), F.coalesce("parts", F.lit(1))))
    return rows.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "doc_id", "x").select("doc_id", "ids")


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    from tidewater.llm.tokenize import WordBpe

    if path not in _TOKENIZERS:  # one for each worker, with its cache
        _TOKENIZERS[path] = WordBpe(path)
    return _TOKENIZERS[path]


def document_frequencies(tokens: DataFrame, kind: str) -> np.ndarray:
    """Documents that have each token id, counted over all documents; the last entry is their number."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _TOKENIZERS.clear()
        release()
        totals, docs = np.zeros(1, np.int64), 0
        for part in parts:
            ids = [np.frombuffer(x, kind) for x in part["ids"]]
            docs += len(ids)
            sizes = np.array([len(x) for x in ids], np.int64)
            for low, high in _batches(sizes):
                here = np.bincount(_term_counts(ids[low:high], sizes[low:high])[1])
                if len(here) > len(totals):
                    here, totals = totals, here
                totals[: len(here)] += here
        there = np.flatnonzero(totals)
        yield pd.DataFrame({"id": np.append(there, -1), "n": np.append(totals[there], docs)})
        release()

    rows = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    docs = int(rows.loc[rows["id"] < 0, "n"].sum())
    rows = rows[rows["id"] >= 0]
    out = np.zeros(int(rows["id"].max()) + 2 if len(rows) else 1, np.int64)
    out[rows["id"]] = rows["n"]
    out[-1] = docs
    return out


class Shard:
    """The BM25 index of a bounded set of documents, and its greedy packing."""

    def __init__(self, ids: list[np.ndarray], frequencies: np.ndarray, mean: float) -> None:
        self.sizes = np.array([len(x) for x in ids], np.int64)
        rows = np.repeat(np.arange(len(ids)), self.sizes)
        pairs, counts = np.unique((np.concatenate(ids).astype(np.int64) << 20) | rows, return_counts=True)
        self.terms, self.rows = pairs >> 20, pairs & ((1 << 20) - 1)
        total = frequencies[-1]
        df = frequencies[self.terms]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.impacts = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * self.sizes[self.rows] / mean))
        self.first = np.searchsorted(self.terms, np.arange(int(self.terms[-1]) + 2))
        self.by_row = np.argsort(self.rows, kind="stable")
        self.row_first = np.searchsorted(self.rows[self.by_row], np.arange(len(ids) + 1))
        self.unused = np.ones(len(ids), bool)

    def neighbours(self, seed: int) -> list[int]:
        """The best unused documents for the seed's weightiest terms, of those that other documents here have."""
        own = self.by_row[self.row_first[seed] : self.row_first[seed + 1]]
        own = own[self.first[self.terms[own] + 1] - self.first[self.terms[own]] > 1]
        if not len(own):
            return []
        terms = self.terms[own[np.argsort(-self.impacts[own], kind="stable")[:QUERY_TERMS]]]
        spans = [slice(self.first[t], self.first[t + 1]) for t in terms.tolist()]
        scores = np.bincount(np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.impacts[s] for s in spans]), len(self.sizes))
        scores[~self.unused] = 0
        best = np.argpartition(-scores, min(FETCH, len(scores) - 1))[:FETCH]
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))].tolist()

    def pack(self, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces ``(document, start, length, sequence, offset)``; every token is in one."""
        sequence = offset = nextup = 0
        held: list[tuple[int, int, int, int]] = []  # pieces of the open window
        seed, queue = None, []
        while True:
            if seed is None or not queue:
                queue = [d for d in self.neighbours(seed) if self.unused[d]] if seed is not None else []
                if not queue:
                    while nextup < len(self.unused) and not self.unused[nextup]:
                        nextup += 1
                    if nextup == len(self.unused):
                        break
                    queue = [nextup]
            document = queue.pop(0)
            if not self.unused[document]:
                continue
            self.unused[document] = False
            if seed is None:
                seed = document
            at, size = 0, int(self.sizes[document])
            while at < size:
                take = min(size - at, window - offset)
                held.append((document, at, take, offset))
                at += take
                offset += take
                if offset == window:
                    yield from ((d, s, n, sequence, o) for d, s, n, o in held)
                    held, offset, sequence = [], 0, sequence + 1
                    seed, queue = (document if at < size else None), []  # the rest seeds the next window
        yield from self._tail(held, offset, sequence)

    @staticmethod
    def _tail(held: list[tuple[int, int, int, int]], total: int, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
        """The last window as sequences of falling powers of two."""
        low = 0
        while low < total:
            high = low + (1 << ((total - low).bit_length() - 1))
            for d, s, n, o in held:
                a, b = max(o, low), min(o + n, high)
                if a < b:
                    yield d, s + a - o, b - a, sequence, a - low
            low, sequence = high, sequence + 1


def packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All pieces of all documents; see PIECES.

    Every row is packed whole, repeated rows and rows with a null id each for themselves; null and empty texts have one
    token, END_ID. ``sequence_id`` holds the partition's number above 32 bits, and rows stand in a fixed order, so a task run
    again gives the same rows. Columns beside id and text are not read; an empty table gives no pieces. Tokens are shuffled once, by content. Padding can only fall in sequences shorter than ``window``, whose
    lengths are powers of two.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, path, doc_id, text)
    kind = id_type(path)
    frequencies = document_frequencies(tokens, kind)
    sums = tokens.agg(F.sum(F.length("ids")).alias("n")).first()["n"]
    mean = max(1.0, (sums or 0) / np.dtype(kind).itemsize / max(1, int(frequencies[-1])))
    sent = spark.sparkContext.broadcast(frequencies)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _TOKENIZERS.clear()  # this worker has tokenized before
        release()
        base = TaskContext.get().partitionId() << 32
        for own, ids in _shards(parts, kind):
            rows, used = [], 0
            for d, start, length, sequence, offset in Shard(ids, sent.value, mean).pack(window):
                crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
                rows.append((own[d], start, length, crc, len(ids[d]), base + sequence, offset))
                used = max(used, sequence + 1)
            base += used
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})
            del rows, own, ids
        release()

    return by_content(tokens).mapInPandas(pack, PIECES)


def _shards(parts: Iterator[pd.DataFrame], kind: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    own, ids, size = [], [], 0
    for part in parts:
        for name, raw in zip(part["doc_id"].astype("Int64"), part["ids"], strict=True):
            x = np.frombuffer(raw, kind)
            if ids and (size + len(x) > SHARD_TOKENS or len(ids) >= SHARD_DOCS):
                yield own, ids
                own, ids, size = [], [], 0
            own.append(name)
            ids.append(x)
            size += len(x)
    if ids:
        yield own, ids
