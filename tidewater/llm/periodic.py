"""Periodic runs of words: suffix trees with constant-time common extensions, Lyndon roots extended both ways.

Where a run may stand is found first on whole batches: every trigram of words of a run of period q, but those of its first
q words, has come at most q words before, so a run of at least LEAST words and TIMES periods leaves a long stretch of
trigrams that come again nearby. Stretches with their margins hold all runs whole; words elsewhere are in none. Over each stretch stand
two suffix trees by Ukkonen's algorithm, of its words and of their reversal. A walk round a tree (its Euler tour, of which only the leaves
and the least depth between neighbours are kept) gives the order of the suffixes, and a sparse table over the depths answers the longest
common extension of two places at once. The longest Lyndon word at each place, for the order of the words and its opposite,
reaches to the next smaller or next greater suffix; one of them is a root of every run, so each is extended to the right
by the first tree and to the left by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches

#: A run has at least LEAST words and TIMES periods.
LEAST = 6
TIMES = 4
RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


class SuffixTree:
    """Ukkonen's tree of a list of numbers from 1, with 0 put at its end; ranks of the suffixes and their common prefixes."""

    def __init__(self, words: list[int]) -> None:
        text = [*words, 0]
        n, base = len(text), max(text) + 1
        starts, ends, links = [0], [0], [0]
        edges: dict[int, int] = {}  # node * base + first number of the edge: node below
        node = at = length = open_suffixes = 0
        for i, c in enumerate(text):
            open_suffixes += 1
            waits = 0  # an inner node made in this phase that has no suffix link yet
            while open_suffixes:
                if not length:
                    at = i
                key = node * base + text[at]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(starts)
                    starts.append(i), ends.append(n), links.append(0)
                    if waits:
                        links[waits] = node
                        waits = 0
                else:
                    first = starts[below]
                    size = min(ends[below], i + 1) - first
                    if length >= size:
                        at += size
                        length -= size
                        node = below
                        continue
                    if text[first + length] == c:
                        length += 1
                        if waits:
                            links[waits] = node
                        break
                    split = len(starts)
                    edges[key] = split
                    starts += (first, i)
                    ends += (first + length, n)
                    links += (0, 0)
                    edges[split * base + c] = split + 1
                    starts[below] = first + length
                    edges[split * base + text[first + length]] = below
                    if waits:
                        links[waits] = split
                    waits = split
                open_suffixes -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    at = i - open_suffixes + 1
        self._walk(n, base, starts, ends, edges)

    def _walk(self, n: int, base: int, starts: list[int], ends: list[int], edges: dict[int, int]) -> None:
        """Round the tree, children by their first number: suffixes at the leaves, least depth since the leaf before."""
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        bounds = np.searchsorted(keys[order] // base, np.arange(len(starts) + 1)).tolist()
        depths = [0] * len(starts)
        leaves, between, stack = [], [], [(0, 0)]
        low = -1  # depth of the node below which the next leaf parts from the last one
        while stack:
            v, above = stack.pop()
            if low < 0:
                low = above
            a, b = bounds[v], bounds[v + 1]
            if a == b:
                leaves.append(starts[v] - above)
                between.append(low)
                low = -1
                continue
            deep = depths[v]
            for child in reversed(children[a:b]):
                depths[child] = deep + ends[child] - starts[child]
                stack.append((child, deep))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        rows = [np.array(between, np.int32)]
        while 2 << (len(rows) - 1) <= n:
            half, last = 1 << (len(rows) - 1), rows[-1]
            rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
        self.least = np.stack(rows)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at ``a`` and ``b``, pairwise different."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level)]).astype(np.int64)


def _next_beyond(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank; 0 if there is none."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """All maximal runs ``(start, length, period)`` of at least LEAST words and TIMES periods; numbers from 1."""
    n = len(words)
    if n < LEAST:
        return []
    forward, back = SuffixTree(words), SuffixTree(words[::-1])
    rank = forward.rank
    beyond = np.array([_next_beyond(rank.tolist()), _next_beyond((-rank).tolist())])[:, :n]
    found = set()
    for after in beyond:
        at = np.flatnonzero((after > 0) & (after < n))
        period = after[at] - at
        right = forward.common(at, at + period)
        left = np.zeros(len(at), np.int64)
        inner = at > 0
        left[inner] = back.common(n - at[inner], n - at[inner] - period[inner])
        length = left + period + right
        keep = length >= np.maximum(LEAST, TIMES * period)
        found.update(zip((at - left)[keep].tolist(), length[keep].tolist(), period[keep].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of places, each within one document, that hold every run with a word on either side.

    ``hashes``: equal for equal words; ``document``: the number of each word's document, ascending.
    """
    n = len(hashes)
    if n < LEAST:
        return []
    h = hashes.astype(np.uint64)
    code = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    inside = np.flatnonzero(document[:-2] == document[2:])
    order = inside[np.argsort(code[inside], kind="stable")]
    again = np.flatnonzero((code[order[1:]] == code[order[:-1]]) & (document[order[1:]] == document[order[:-1]]))
    gap = np.full(n + 1, n, np.int64)
    gap[order[again + 1]] = order[again + 1] - order[again]
    first = np.searchsorted(document, document)  # where each word's document begins
    last = np.searchsorted(document, document, "right")
    ranges: list[tuple[int, int]] = []
    low, high = 1, 1
    while TIMES * low <= n:
        least = max(LEAST, TIMES * low) - 2 - low
        near = np.concatenate(([False], gap <= high))
        edges = np.flatnonzero(near[1:] != near[:-1])
        begins, ends = edges[::2], edges[1::2]
        # trigrams of two documents never stand side by side: the last two words of each begin none
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if len(begins) else ():
            if b - a >= least:
                ranges.append((max(first[a], a - high - 1), min(last[a], b + 3)))
        low, high = high + 1, 2 * high
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1] and document[a] == document[out[-1][0]]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((int(a), int(b)))
    return out


def scan(texts: list[str | None]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs of each text, by start and period, and its words without the repeats, joined by single spaces."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # white space of ASCII only
    sizes = np.array([len(w) for w in split], np.int64)
    before = np.cumsum(sizes) - sizes
    hashes = np.fromiter((hash(w) for words in split for w in words), np.int64, int(sizes.sum()))
    document = np.repeat(np.arange(len(split)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(hashes, document):
        d = int(document[a])
        a, b = a - int(before[d]), b - int(before[d])
        numbers: dict[bytes, int] = {}
        found[d] += [(a + s, n, p) for s, n, p in runs_of([numbers.setdefault(w, len(numbers) + 1) for w in split[d][a:b]])]
    kept = []
    for words, own in zip(split, found, strict=True):
        if own:
            own.sort(key=lambda r: (r[0], r[2]))
            keep = np.ones(len(words), bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return found, kept


#: Bytes of texts that are scanned at once.
AT_ONCE = 2 << 20


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))
    for batch in batches:
        low = 0
        texts = batch.column("text")
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < AT_ONCE):
                size += len(texts[high].as_py() or "")
                high += 1
            found, kept = scan(texts.slice(low, high - low).to_pylist())
            runs = pa.array([[dict(zip(RUN.names, r, strict=True)) for r in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("d").slice(low, high - low), runs, pa.array(kept, pa.string())], names=["d", "runs", "collapsed"])
            low = high


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all without it) of ``docs`` as struct ``d``, ``runs`` of words and the text ``collapsed``.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with smallest period q, words q apart being identical, of at
    least ``LEAST`` words and ``TIMES`` periods, that no neighbouring word extends; ``runs`` are ``start, length, period`` in words from
    0, by start and period, an empty list if there is none. ``collapsed`` leaves out all words of a run after its first q and joins the
    rest by one space. Each row is scanned on its own, whole and without a shuffle, so repeated rows give equal results; null and empty
    texts have no runs and an empty ``collapsed``; columns of any name may stand beside the text; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)]
    sent = docs.select(F.struct(*columns).alias("d"), F.col(text).alias("text"))
    schema = T.StructType().add(sent.schema["d"]).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    return sent.mapInArrow(_scans, schema)
