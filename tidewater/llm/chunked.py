"""BPE ids of whole texts from chunks that are cut where their content says and encoded once.

A rolling hash over WINDOW bytes cuts a text wherever it ends in zeros, so passages that documents share fall into equal chunks
wherever they stand. Chunks are counted over all documents by 128-bit hashes; those whose repeats hold most bytes are encoded by one job, up to
a bound of bytes, and sent to all tasks; a task encodes any other chunk when it first meets it and keeps its ids.

The ids of a chunk are right but for its two ends, where the cut may part a word. The tokenizer drops white space and never
merges across it, so a join is repaired by encoding what stands between the last white space before and the first one behind it; a chunk
without any becomes part of a longer join, until both ends stand at white space or at an end of the text. There the ids agree with those
of the chunks, and the whole with those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches, release
from tidewater.llm.tokenize import WordBpe
from tidewater.sources.shared import written

#: Bytes the rolling hash covers, and of a chunk: at least, at most, and zero bits that end one (512 bytes on average).
WINDOW = 32
SHORTEST = 128
LONGEST = 4096
ZEROS = 9
#: Bytes of chunks sent to all tasks, at most; of chunks a worker keeps besides; of texts encoded at once.
SENT = 16 << 20
KEPT = 24 << 20
AT_ONCE = 1 << 20
#: Hashes a task counts before it gives them on.
HELD = 200_000
_BASE = 0x9E3779B97F4A7C15
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

#: A chunk's ids in three parts, and the texts of the first and last: what stands before its first white space, from there to its last one, and
#: behind that. A chunk without white space has a first part only, and no second (None).
Record = tuple[bytes, bytes, bytes, "bytes | None", bytes]


class Kept(dict[bytes, Record]):
    """Chunks a worker has encoded, by hash, and their bytes."""

    size = 0


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Each text in pieces, cut between characters where the hash of the last WINDOW bytes ends in zeros."""
    letters = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    n = len(letters)
    rise, fall = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    rise[0] = fall[0] = 1
    np.cumprod(rise, out=rise)
    np.cumprod(fall, out=fall)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * rise[:-1], dtype=np.uint64)))
    rolled = (sums[WINDOW:-1] - sums[: -WINDOW - 1]) * fall[: -WINDOW - 1] if n > WINDOW else np.zeros(0, np.uint64)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    inner = (letters & 0xC0) == 0x80  # bytes inside a character
    hits = np.flatnonzero((rolled >> np.uint64(64 - ZEROS) == 0) & ~inner[WINDOW:]) + WINDOW  # the chunk ends before this byte
    out, begin = [], 0
    bounds = np.searchsorted(hits, np.cumsum([0, *map(len, texts)]))
    for k, text in enumerate(texts):
        end, last, own = begin + len(text), begin, []
        for hit in [*hits[bounds[k] : bounds[k + 1]].tolist(), end]:
            while hit - last > LONGEST:
                forced = last + LONGEST
                while forced < end and inner[forced]:
                    forced += 1
                own.append(text[last - begin : forced - begin])
                last = forced
            if hit - last >= SHORTEST or (hit == end and hit > last):
                own.append(text[last - begin : hit - begin])
                last = hit
        out.append(own)
        begin = end
    return out


def name_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def records(encoder: WordBpe, pieces: list[bytes]) -> list[Record]:
    """Chunks encoded by themselves."""
    parts: list[bytes] = []
    for piece in pieces:
        plain = piece.translate(_WHITE)
        first, last = plain.find(b" "), plain.rfind(b" ")
        parts += (piece, b"", b"") if first < 0 else (piece[:first], piece[first : last + 1], piece[last + 1 :])
    ids = encoder.encode([p.decode("utf-8", "replace") for p in parts])
    return [(parts[i], ids[i], ids[i + 1], parts[i + 2] if parts[i + 1] else None, ids[i + 2]) for i in range(0, len(parts), 3)]


def encode(encoder: WordBpe, texts: list[bytes], sent: dict[bytes, Record], kept: Kept) -> list[bytes]:
    """Little-endian ids of 32 bits of each text; chunks that are in neither table come into ``kept``."""
    split = chunks(texts)
    names = [[name_of(c) for c in own] for own in split]
    new = {n: c for own, known in zip(split, names, strict=True) for c, n in zip(own, known, strict=True) if n not in sent and n not in kept}
    if kept.size > KEPT:
        new |= {n: c for own, known in zip(split, names, strict=True) for c, n in zip(own, known, strict=True) if n in kept}
        kept.clear()
        kept.size = 0
    kept.update(zip(new, records(encoder, list(new.values())), strict=True))
    kept.size += sum(map(len, new.values()))
    parts: list[list[bytes | None]] = []  # of each text; None where a join is
    joins: list[bytes] = []
    for known in names:
        own: list[bytes | None] = []
        open_text, open_ids = b"", b""  # behind the last white space
        joined = False

        def close(own=own) -> None:
            if joined:
                joins.append(open_text)
            own.append(None if joined else open_ids)

        for n in known:
            head, head_ids, middle, tail, tail_ids = sent.get(n) or kept[n]
            if head:
                joined = joined or bool(open_text)
                open_ids = head_ids
                open_text += head
            if tail is None:
                continue
            close()
            own.append(middle)
            open_text, open_ids, joined = tail, tail_ids, False
        close()
        parts.append(own)
    repaired = iter(encoder.encode([j.decode("utf-8", "replace") for j in joins]))
    return [b"".join(next(repaired) if p is None else p for p in own) for own in parts]


def decoder(path: str) -> np.ndarray:
    """The strings of all ids, as the tokenizer without a decoder joins them by spaces."""
    model = json.loads(open(path, encoding="utf-8").read())
    if model["decoder"] is not None:
        raise ValueError("only tokenizers without a decoder")
    vocab = model["model"]["vocab"] | {t["content"]: t["id"] for t in model["added_tokens"]}
    out = np.full(max(vocab.values()) + 1, b"", object)
    for token, i in vocab.items():
        out[i] = token.encode()
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in parts of a bounded size, with their texts; null is empty."""
    for batch in batches:
        texts, low = batch.column("text"), 0
        while low < len(texts):
            part, size = [], 0
            while low + len(part) < len(texts) and size < AT_ONCE:
                part.append((texts[low + len(part)].as_py() or "").encode("utf-8", "replace"))
                size += len(part[-1])
            yield batch.slice(low, len(part)), part
            low += len(part)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of chunks with their sizes and numbers within this task."""
    held: dict[tuple[bytes, int], int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in held], pa.binary()), pa.array([s for _, s in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["name", "size", "n"]
        )

    for _, texts in _texts(batches):
        for own in chunks(texts):
            for c in own:
                key = (name_of(c), len(c))
                held[key] = held.get(key, 0) + 1
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()
    release()


def _chosen(wanted):
    """The chunks whose hashes were sent, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted.value)
        for _, texts in _texts(batches):
            found = {n: c for own in chunks(texts) for c in own if (n := name_of(c)) in left}
            left -= found.keys()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["name", "chunk"])

    return run


_ENCODERS: dict[str, tuple[WordBpe, np.ndarray, Kept]] = {}


def _encoder(path: str) -> tuple[WordBpe, np.ndarray, Kept]:
    if path not in _ENCODERS:
        _ENCODERS[path] = (WordBpe(path), decoder(path), Kept())
    return _ENCODERS[path]


_RECORD = "name binary, head binary, head_ids binary, middle binary, tail binary, tail_ids binary"


def _recorder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = records(_encoder(path)[0], batch.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("name"), *[pa.array(list(x), pa.binary()) for x in zip(*made, strict=True)]] if made else [pa.array([], pa.binary())] * 6, names=["name", "head", "head_ids", "middle", "tail", "tail_ids"])

    return run


def shared_chunks(docs: DataFrame, path: str, text: str = "text", sent: int = SENT) -> DataFrame:
    """The repeated chunks of all documents that save most bytes, each encoded once: at most ``sent`` bytes of them.

    Chosen by the power of two of the bytes their repeats hold, as many powers as stay within the bound.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(text).alias("text"))
    counts = texts.mapInArrow(_counts, "name binary, size int, n long").groupBy("name").agg(F.max("size").alias("size"), F.sum("n").alias("n")).where("n > 1")
    saved = written(counts.withColumn("level", F.floor(F.log2((F.col("n") - 1) * F.col("size")))), "chunk-counts")
    sizes = {r["level"]: r["bytes"] for r in saved.groupBy("level").agg(F.sum("size").alias("bytes")).collect()}  # at most 64 rows
    level, total = 64, 0
    while level and total + sizes.get(level - 1, 0) <= sent:
        level -= 1
        total += sizes.get(level, 0)
    wanted = spark.sparkContext.broadcast([bytes(r["name"]) for r in saved.where(F.col("level") >= level).select("name").collect()])  # sent / SHORTEST rows at most, and last chunks of texts
    found = texts.mapInArrow(_chosen(wanted), "name binary, chunk binary").groupBy("name").agg(F.first("chunk").alias("chunk"))
    return written(found.mapInArrow(_recorder(path), _RECORD), "chunk-ids")


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, sent: int = SENT) -> DataFrame:
    """Columns ``keep`` (all without it) of ``docs`` as struct ``d``, with ``ids`` and ``decoded``.

    ``ids``: little-endian unsigned 32-bit ids of the whole text by the tokenizer in the file ``path``, special tokens not added; ``decoded``: their
    strings as the tokenizer decodes them, special ones not skipped. Null and empty texts have no ids and an empty ``decoded``. Each row is
    encoded by itself and in place, so repeated rows give equal results, and no copy, chunk or source is a hot key; columns of any name may
    stand beside the text; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)]
    rows = shared_chunks(docs, path, text, sent).collect()  # bounded by ``sent``
    table = spark.sparkContext.broadcast({bytes(r[0]): tuple(None if x is None else bytes(x) for x in r[1:]) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, strings, kept = _encoder(path)
        for batch, texts in _texts(batches):
            ids = encode(encoder, texts, table.value, kept)
            decoded = [b" ".join(strings[np.frombuffer(x, "<u4")].tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], names=["d", "ids", "decoded"])
        release()

    bound_batches(spark)
    given = docs.select(F.struct(*columns).alias("d"), F.col(text).alias("text"))
    return given.mapInArrow(run, T.StructType([given.schema["d"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
