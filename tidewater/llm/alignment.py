"""Alignment of two tokenizers over the same bytes, and how often each pair of their ids covers a common byte.

Both tokenizers' tokens are ranges of the same bytes, so a text is two ascending lists of token ends. The shorter one drives a galloping
search in the longer: from the place found last, steps double until they pass the end looked for, then a binary search ends
between the last two; blocks of the shorter list do so side by side, on whole arrays. Ends found in both lists slice the tokens into groups; the
differences of the ranks found are the ranges of tokens that overlap, so links are written out without comparing any two tokens.

Links are counted over all documents. Pairs seen often enough that at most HOT of them exist are sent to all tasks; the links of the other
pairs, which are rare by that, are joined to their counts by pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches, release
from tidewater.llm.tokenize import ChunkTable
from tidewater.sources.shared import written

#: Pairs whose counts are sent to all tasks, at most: 17 MB as arrays.
HOT = 1 << 20
#: Needles of one block, and bytes of texts aligned at once.
BLOCK = 32
AT_ONCE = 1 << 20
#: Distinct pairs a task holds before it gives their counts on.
HELD = 2_000_000
#: Segments and ids kept in a worker's tables before they are emptied.
CACHE = 400_000
CACHE_IDS = 4_000_000
BASE = 0x9E3779B97F4A7C15

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")])


def printable_bytes() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """A byte-level BPE and a sentencepiece model, with the bytes of all their tokens."""

    #: How the first splits a text before its merges.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        model = json.loads(open(byte_bpe, encoding="utf-8").read())
        special = {t["content"] for t in model["added_tokens"]}
        byte = printable_bytes()
        vocab = sorted((i, bytes(byte[c] for c in t)) for t, i in model["model"]["vocab"].items() if t not in special)
        ids = np.array([i for i, _ in vocab], np.int64)
        order = sorted(range(len(vocab)), key=lambda k: (len(vocab[k][1]) > 1, vocab[k][0]))  # bytes, then merges in their order
        self.first = tiktoken.Encoding("first", pat_str=self.SPLIT, mergeable_ranks={vocab[k][1]: r for r, k in enumerate(order)}, special_tokens={})
        self.id_of_rank = ids[order]
        self.size_a = np.zeros(int(ids.max()) + 1, np.int64)
        self.size_a[ids] = [len(b) for _, b in vocab]
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.n_b = self.second.get_piece_size()
        self.bytes_b = np.empty(self.n_b, object)
        for i in range(self.n_b):
            piece = self.second.id_to_piece(i)
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        if len(self.size_a) * self.n_b >= 1 << 32:
            raise ValueError("vocabularies too large for pairs of 32 bits")
        pieces_across = [p for p in (self.second.id_to_piece(i) for i in range(self.n_b)) if "▁" in p.lstrip("▁")]
        if pieces_across:
            raise ValueError(f"pieces across words: {pieces_across[:3]}")
        self._empty()
        self.digits = [_digits(len(self.size_a)), _digits(self.n_b)]

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both in a row, how many of each a segment has, and whether the bytes of both are the segment's."""
        text = b"".join(segments)
        a, b = self._both(text)
        ends = np.cumsum([len(x) for x in segments])
        if len(segments) > 1 and not (self._same(a, text) and b"".join(self.bytes_b[b].tolist()) == text):
            each = [self._encode([x]) for x in segments]
            return tuple(np.concatenate(x) for x in zip(*each, strict=True))
        if len(segments) == 1:
            good = self._same(a, text) and b"".join(self.bytes_b[b].tolist()) == text
            return a, np.array([len(a)]), b, np.array([len(b)]), np.array([good])
        counts = [np.diff(np.searchsorted(np.cumsum(size[x]), ends, "right"), prepend=0) for x, size in ((a, self.size_a), (b, self.size_b))]
        return a, counts[0], b, counts[1], np.ones(len(segments), bool)

    def _both(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        a = self.id_of_rank[self.first.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=())]
        return a, np.array(self.second.encode(text[1:].decode("utf-8", "replace"), num_threads=1), np.int64)

    def _same(self, a: np.ndarray, text: bytes) -> bool:
        return int(self.size_a[a].sum()) == len(text)  # a byte-level encoder changes nothing but what is no UTF-8

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both in a row, numbers of each by text, and whether a text's bytes are kept; each text begins with a space.

        Texts are cut before single spaces between characters that are surely no white space. Neither tokenizer has a token across
        such a place, so what stands between two is encoded once, and looked up by a 64-bit hash where it comes again.
        """
        joined = b"".join(texts)
        letters = np.frombuffer(joined + b"  ", np.uint8)
        solid = (letters > 0x20) & (letters < 0x7F)
        pair = (letters >= 0xC3) & (letters < 0xE0)  # first bytes of characters of two bytes; white space has others
        before = np.zeros(len(letters), bool)
        before[1:] = solid[:-1]
        before[2:] |= pair[:-2]
        cut = (letters == 0x20) & before
        cut[:-1] &= (solid | pair)[1:]
        cut[-2:] = False
        lengths = np.array([len(t) for t in texts], np.int64)
        ends_of_texts = np.cumsum(lengths)
        cut[ends_of_texts - lengths] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(joined))
        hashes = _hashes(letters[: len(joined)], starts, ends)
        entries = self.table_a.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            if self.table_a.size + len(missing) > CACHE or self.table_a.bounds[self.table_a.size] > CACHE_IDS:
                self._empty()
                missing = np.arange(len(hashes))
            fresh, first = np.unique(hashes[missing], return_index=True)
            where = missing[first]
            # what ends a text may end in white space, and is encoded by itself
            last = np.isin(ends[where], ends_of_texts)
            for part in (np.flatnonzero(~last), *np.flatnonzero(last)[:, None]):
                if len(part):
                    spans = zip(starts[where[part]].tolist(), ends[where[part]].tolist(), strict=True)
                    a, n_a, b, n_b, good = self._encode([joined[x:y] for x, y in spans])
                    self.good = np.append(self.good, good)
                    self.table_a.add(fresh[part], n_a, a)
                    self.table_b.add(fresh[part], n_b, b)
            entries[missing] = self.table_a.find(hashes[missing])
        a, n_a = self.table_a.runs(entries)
        b, n_b = self.table_b.runs(entries)
        at = np.searchsorted(starts, ends_of_texts - lengths)
        return a.astype(np.int64), np.add.reduceat(n_a, at), b.astype(np.int64), np.add.reduceat(n_b, at), np.logical_and.reduceat(self.good[entries], at)

    def _empty(self) -> None:
        self.table_a, self.table_b, self.good = ChunkTable(), ChunkTable(), np.zeros(0, bool)


def _hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes that follow each other without gaps: differences of running sums of an odd multiplier's powers."""
    rise = np.full(len(letters) + 1, BASE, np.uint64)
    fall = np.full(len(letters) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    rise[0] = fall[0] = 1
    rise, fall = np.cumprod(rise, dtype=np.uint64), np.cumprod(fall, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * rise[:-1], dtype=np.uint64)))
    out = (sums[ends] - sums[starts]) * fall[starts] + (ends - starts).astype(np.uint64)
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def _digits(n: int) -> np.ndarray:
    """Decimal digits of the numbers below n, from the right, zero bytes before them, and a place for a separator."""
    width = len(str(max(n - 1, 0)))
    return np.array([list(str(i).encode().rjust(width, b"\0") + b"\0") for i in range(n)], np.uint8)


def gallop(needles: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each needle the first place from ``low`` on whose value is not smaller, all before ``high``; exponential, then binary search."""
    at, step = low.copy(), np.ones(len(needles), np.int64)
    limit = high - 1
    go = np.flatnonzero(longer[np.minimum(at, limit)] < needles)
    top = at.copy()
    while len(go):
        at[go] = top[go] + 1  # all up to top are smaller
        top[go] = np.minimum(top[go] + step[go], limit[go])
        step[go] *= 2
        go = go[longer[top[go]] < needles[go]]
    open_ = np.flatnonzero(at < top)
    while len(open_):
        middle = (at[open_] + top[open_]) >> 1
        smaller = longer[middle] < needles[open_]
        at[open_] = np.where(smaller, middle + 1, at[open_])
        top[open_] = np.where(smaller, top[open_], middle)
        open_ = open_[at[open_] < top[open_]]
    return at


def ranks(shorter: np.ndarray, longer: np.ndarray, sizes: np.ndarray, longer_sizes: np.ndarray) -> np.ndarray:
    """Place in ``longer`` of the first end not before each end of ``shorter``; both ascend over documents of the given sizes."""
    starts = np.cumsum(longer_sizes) - longer_sizes
    low, high = np.repeat(starts, sizes), np.repeat(starts + longer_sizes, sizes)
    out = np.empty(len(shorter), np.int64)
    heads = np.arange(0, len(shorter), BLOCK)
    found = gallop(shorter[heads], longer, low[heads], high[heads])
    out[heads] = found
    for k in range(1, BLOCK):
        heads = heads[heads + k < len(shorter)]
        found = found[: len(heads)]
        here = heads + k
        found = gallop(shorter[here], longer, np.maximum(found, low[here]), high[here])
        out[here] = found
    return out


def _halves(shorter: np.ndarray, longer: np.ndarray, sizes: np.ndarray, longer_sizes: np.ndarray):
    """By the shorter side: common flags of both sides, and every link as two places."""
    rank = ranks(shorter, longer, sizes, longer_sizes)
    common = longer[rank] == shorter
    starts = np.cumsum(longer_sizes) - longer_sizes
    first = np.empty_like(rank)  # where the range of each token begins: after the rank of the one before, if that end is common
    first[1:] = rank[:-1] + common[:-1]
    head = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[head] = starts[sizes > 0]
    counts = rank - first + 1
    one = np.repeat(np.arange(len(shorter)), counts)
    other = np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts - first, counts)
    mark = np.zeros(len(longer), bool)
    mark[rank[common]] = True
    return common, mark, one, other


def _taken(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of the given sizes in another order."""
    starts, counts = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return values[np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)]


def align(pair: Pair, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[bytes]]:
    """Numbers of each text by column, its links as codes ``a * n_b + b``, and the string of its groups."""
    n = len(texts)
    at = np.array([i for i, text in enumerate(texts) if text], np.int64)
    numbers = {c: np.zeros(n, np.int64) for c in PIECES.names}
    links, strings = [np.zeros(0, np.uint32)] * n, [b""] * n
    if not len(at):
        return numbers, links, strings
    a, size_a, b, size_b, good = pair.tokens([b" " + texts[i].encode("utf-8", "replace") for i in at])
    # texts whose first list is the shorter one come first, so that each half is two ascending lists
    turn = np.argsort(np.where(good, size_a > size_b, 2), kind="stable")[: int(good.sum())]
    a, b = _taken(a, size_a, turn), _taken(b, size_b, turn)
    at_, size_a, size_b = at[turn], size_a[turn], size_b[turn]
    cut = int((size_a <= size_b).sum())
    if not len(at_):
        return numbers, links, strings
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    cut_a, cut_b = int(size_a[:cut].sum()), int(size_b[:cut].sum())
    common_a, common_b, one, other = _halves(end_a[:cut_a], end_b[:cut_b], size_a[:cut], size_b[:cut])
    common_b2, common_a2, two, other2 = _halves(end_b[cut_b:], end_a[cut_a:], size_b[cut:], size_a[cut:])
    common_a, common_b = np.concatenate([common_a, common_a2]), np.concatenate([common_b, common_b2])
    link_a, link_b = np.concatenate([one, other2 + cut_a]), np.concatenate([other, two + cut_b])
    codes = (a[link_a] * pair.n_b + b[link_b]).astype(np.uint32)
    # the first half's links ascend by token of a, the second's by token of b: both ascend by document
    document = np.repeat(np.arange(len(at_)), size_a)
    per_text = np.bincount(document[link_a], minlength=len(at_))
    groups = np.bincount(document[common_a], minlength=len(at_))
    edges = np.cumsum(per_text) - per_text
    for k, i in enumerate(at_.tolist()):
        links[i] = codes[edges[k] : edges[k] + per_text[k]]
    for column, values in zip(PIECES.names, (size_a, size_b, groups, per_text), strict=True):
        numbers[column][at_] = values
    # groups one after another, in each the ids of a and then those of b
    last_a, last_b = np.flatnonzero(common_a) + 1, np.flatnonzero(common_b) + 1
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    place_a = np.arange(len(a)) + np.concatenate(([0], last_b))[group_a]
    place_b = np.arange(len(b)) + last_a[group_b]
    digits_a, digits_b = pair.digits
    width = max(digits_a.shape[1], digits_b.shape[1])
    rows = np.zeros((len(a) + len(b), width), np.uint8)
    rows[place_a, width - digits_a.shape[1] :] = digits_a[a]
    rows[place_b, width - digits_b.shape[1] :] = digits_b[b]
    rows[place_a, -1] = np.where(common_a, ord("|"), ord(","))
    rows[place_b, -1] = np.where(common_b, ord(";"), ord(","))
    lengths = np.count_nonzero(rows, axis=1)
    flat = rows.ravel()
    flat = flat[flat != 0].tobytes()
    tokens = np.cumsum(size_a + size_b)
    ends = np.cumsum(lengths)[tokens - 1].tolist()
    begin = 0
    for i, end in zip(at_.tolist(), ends, strict=True):
        strings[i] = flat[begin : end - 1]
        begin = end
    return numbers, links, strings


_PAIRS: dict[tuple[str, str], Pair] = {}


def _aligner(byte_bpe: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_bpe, pieces) not in _PAIRS:
            _PAIRS[byte_bpe, pieces] = Pair(byte_bpe, pieces)
        pair = _PAIRS[byte_bpe, pieces]
        for batch in batches:
            texts, low = batch.column("text"), 0
            while low < len(texts):
                part, size = [], 0
                while low + len(part) < len(texts) and size < AT_ONCE:
                    part.append(texts[low + len(part)].as_py())
                    size += len(part[-1] or "")
                numbers, links, strings = align(pair, part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").slice(low, len(part)), *[pa.array(numbers[c]) for c in PIECES.names],
                     pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in strings]), pa.array([x.astype("<u4").tobytes() for x in links], pa.binary())],
                    names=["d", *PIECES.names, "groups_sha256", "links"],
                )
                low += len(part)
        release()

    return run


def align_texts(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` as struct ``d``, ``n_a, n_b, n_groups, n_links``, ``groups_sha256`` and ``links``, all links as little-endian codes of 32 bits."""
    bound_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)]
    sent = docs.select(F.struct(*columns).alias("d"), F.col(text).alias("text"))
    schema = T.StructType([sent.schema["d"], *PIECES, T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])
    return sent.mapInArrow(_aligner(byte_bpe, pieces), schema)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and their links, summed within a task."""
    held = pd.Series(dtype=np.int64)
    waiting: list[pa.Array] = []
    size = 0

    def merged() -> pd.Series:
        found = pc.value_counts(pa.chunked_array(waiting))
        new = pd.Series(found.field("counts").to_numpy(), found.field("values").to_numpy())
        return pd.concat([held, new]).groupby(level=0, sort=False).sum() if len(held) else new

    def out(sums: pd.Series) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums.index.to_numpy().astype(np.int64)), pa.array(sums.to_numpy().astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<u4")
        waiting.append(pa.array(codes))
        size += len(codes)
        if size >= HELD:
            held, waiting, size = merged(), [], 0
            if len(held) >= HELD:
                yield out(held)
                held = pd.Series(dtype=np.int64)
    if waiting:
        held = merged()
    if len(held):
        yield out(held)
    release()


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: links of each pair over all documents, and whether no other pair with its second id has more."""
    bound_batches(aligned.sparkSession)
    counts = aligned.select("links").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pairs").withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scorer(hot):
    """Sums over the links whose pairs were sent; the others' pairs with their numbers in this document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = hot.value
        index = pd.Index(pairs)
        n, best = np.concatenate([n, [0]]), np.concatenate([best, [False]]).astype(np.int64)
        for batch in batches:
            links = batch.column("links").to_pylist()
            sizes = np.array([len(x) // 4 for x in links], np.int64)
            codes = np.frombuffer(b"".join(links), "<u4")
            place = index.get_indexer(codes)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            sums = [np.concatenate(([0], np.cumsum(x[place])))[bounds] for x in (best, n)]
            rare = np.flatnonzero(place < 0)
            document = np.searchsorted(bounds, rare, "right") - 1
            found = pd.DataFrame({"d": document, "pair": codes[rare].astype(np.int64)}).groupby(["d", "pair"], sort=True).size()
            lists = np.concatenate(([0], np.cumsum(np.bincount(found.index.get_level_values(0), minlength=len(links)))))
            pair = pa.array(found.index.get_level_values(1).to_numpy().astype(np.int64))
            cold = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.StructArray.from_arrays([pair, pa.array(found.to_numpy().astype(np.int64))], names=["pair", "times"]))
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "links"]
            names = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), cold], names=[*names, "n_best", "count_sum", "cold"])
        release()

    return run


def alignment(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Columns ``keep`` (all without it) of ``docs`` as struct ``d``, with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``byte_bpe`` encodes a space and the text, ``pieces`` the text; strings of special tokens are plain text. Byte offsets at which tokens of both end
    cut them into groups; tokens whose bytes overlap are linked. A pair's count is its number of links over all rows of ``docs``;
    ``n_best`` are the links whose pair has the highest count of all pairs with its second id, ties included, ``count_sum`` is the sum of
    the counts over the links. Null and empty texts, and texts whose bytes either tokenizer changes, have no tokens: zeros and an empty string.
    Each row counts by itself, repeated rows and null ids included; columns of any name may stand beside the text; an empty table gives an empty one.

    At most ``hot`` pairs are sent to tasks: those that have at least the least power of two of links that so few reach. The others
    are joined to the documents by pair; each of them has few links, so none is a hot key.
    """
    spark = docs.sparkSession
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    aligned = written(align_texts(docs, byte_bpe, pieces, text, keep), "aligned")
    counts = written(pair_counts(aligned, model.get_piece_size()), "pair-counts")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    level, sent = 64, 0
    while level and sent + sizes.get(level - 1, 0) <= hot:
        level -= 1
        sent += sizes.get(level, 0)
    often = F.floor(F.log2("n")) >= level
    rows = counts.where(often).toPandas()
    table = spark.sparkContext.broadcast((rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)))
    cold = "array<struct<pair:long,times:long>>"
    kept = [f for f in aligned.schema if f.name != "links"]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    bound_batches(spark)
    found = aligned.mapInArrow(_scorer(table), T.StructType([*schema, T.StructField("cold", T._parse_datatype_string(cold))]))
    names = ["d", *PIECES.names, "n_best", "count_sum", "groups_sha256"]
    if not level:  # all pairs were sent
        return found.select(*names)
    scored = written(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    single = scored.select("row", F.explode("cold").alias("c")).select("row", "c.*")
    rest = single.join(counts.where(~often), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    joined = scored.drop("cold").join(rest, "row", "left")
    added = {c: F.col(c) + F.coalesce(F.col(m), F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return joined.withColumns(added).select(*names)
