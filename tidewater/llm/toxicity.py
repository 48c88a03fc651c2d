"""Toxicity by compression distance with two zstandard dictionaries.

The ordinary dictionary is trained on ordinary documents, on the words of theirs that would else pass for toxic; the toxic
one has before that text what toxic documents say and ordinary ones do not. A window that compresses shorter with the toxic
dictionary holds something of the latter, and other windows compress alike. The two largest gains of a document's windows
are calibrated on labelled documents into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, release, uniform

#: Bounds of the fit: toxic and ordinary labelled documents, and characters of a document used for fitting.
TOXIC_SAMPLE = 2000
ORDINARY_SAMPLE = 6000
FIT_CHARS = 20_000
#: Bytes of the dictionaries' parts, words in a window.
ORDINARY_BYTES = 16 << 10
TOXIC_BYTES = 8 << 10
WINDOW_WORDS = 6
#: Bytes that no text has, at the end of every window and both dictionaries: with them every window compresses, so that
#: sizes tell single bytes.
TAIL = bytes([3, 4, 5, 6, 7, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24])
#: A segment of the toxic dictionary is at least this many times as frequent in toxic documents.
ODDS = 10.0
#: Gains above this are not told apart; rounds in which the ordinary dictionary learns from its mistakes.
MOST_GAIN = 24
ROUNDS = 4
_SPACED = bytes(32 if c < 0x41 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c <= 0x5A else c for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower-cased letters, one space between words and around the text."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "


def windows(line: bytes, words: int = WINDOW_WORDS) -> list[bytes]:
    """Windows of whole words with the spaces around them, ended by TAIL; a single space gives none."""
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = spaces[:-1:words].tolist()
    if not starts or len(line) < 3:
        return []
    return [line[a:b] + TAIL for a, b in zip(starts, [x + 1 for x in starts[1:]] + [len(line)], strict=True)]


def _excess(there: int, elsewhere: int, rate: float) -> float:
    """How unlikely ``there`` of all occurrences are at a share of ``rate``: minus log10 of the Chernoff bound."""
    share = there / (there + elsewhere)
    if there * (1 - rate) < ODDS * (elsewhere + 0.5) * rate:
        return 0.0
    rest = (1 - share) * np.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return (there + elsewhere) * (share * np.log(share / rate) + rest) / np.log(10)


def contrast(toxic: list[bytes], ordinary: list[bytes], longest: int = 12) -> list[bytes]:
    """Words and beginnings of words that toxic documents have far more often than chance gives, most telling first.

    A word counts once a document. A segment is taken if its excess outweighs the number of segments looked at; then the
    words it explains are set aside and the rest is looked at again. Of segments that explain about the same the longest is taken.
    """
    bad, good = (Counter(w for line in lines for w in set(line.split())) for lines in (toxic, ordinary))
    rate = sum(bad.values()) / max(1, sum(bad.values()) + sum(good.values()))
    if not 0 < rate < 1:
        return []
    there, elsewhere, words_of = Counter(), Counter(), {}
    for counts, own in ((there, bad), (elsewhere, good)):
        for word, n in own.items():
            for segment in {b" " + word[:k] for k in range(4, min(len(word), longest) + 1)} | ({b" " + word + b" "} if len(word) > 2 else set()):
                counts[segment] += n
    level = np.log10(max(10, len(there)))
    told = {s for s, n in sorted(there.items()) if n > 2 and _excess(n, elsewhere[s], rate) > level}
    for word, n in bad.items():
        for k in range(4, min(len(word), longest) + 1):
            if (s := b" " + word[:k]) in told:
                words_of.setdefault(s, []).append(word)
        if (s := b" " + word + b" ") in told:
            words_of.setdefault(s, []).append(word)
    chosen, gone = [], set()
    while told:
        left = {s: sum(bad[w] for w in words_of[s] if w not in gone) for s in told}
        worth = {s: _excess(n, elsewhere[s], rate) for s, n in left.items() if n > 2}
        worth = {s: x for s, x in worth.items() if x > level}
        if not worth:
            break
        most = max(worth.values())
        best = max((s for s, x in worth.items() if x >= 0.95 * most), key=lambda s: (len(s), worth[s], s))
        chosen.append(best)
        gone.update(words_of[best])
        told = set(worth) - {best}
    return chosen


def without_copies(lines: list[bytes], size: int = 8) -> list[bytes]:
    """One line of each group of near copies: a line that shares half of its least-hashed words, long ones if it has enough, with one before is left
    out, since copies would make their own words look telling."""
    seen: dict[int, list[int]] = {}
    kept: list[bytes] = []
    for line in lines:
        words = set(line.split())
        rare = {w for w in words if len(w) > 6}
        sketch = sorted(map(zlib.crc32, rare if len(rare) >= size else words))[:size]
        shared = Counter(i for x in sketch for i in seen.get(x, ()))
        if sketch and shared and shared.most_common(1)[0][1] * 2 >= len(sketch):
            continue
        for x in sketch:
            seen.setdefault(x, []).append(len(kept))
        kept.append(line)
    return kept


@dataclass
class Model:
    shared: bytes
    toxic: bytes
    #: Probability of the toxic label by largest gain, 0 to MOST_GAIN, and for texts without words.
    curve: list[float]

    def __post_init__(self) -> None:
        make = lambda content: zstd.ZstdCompressor(
            dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT),
            compression_params=zstd.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=5, strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS),
        )
        self.sides = make(self.shared + TAIL), make(self.toxic + self.shared + TAIL)

    def window_gains(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if not parts:
            return np.zeros(0, np.int64)
        found = [side.multi_compress_to_buffer(parts, threads=0) for side in self.sides]
        sizes = [np.fromiter((len(f[i]) for i in range(len(f))), np.int64, len(f)) for f in found]
        return sizes[0] - sizes[1]

    def gains(self, lines: list[bytes]) -> np.ndarray:
        """Sum of the two largest window gains of each line, 0 to MOST_GAIN: ordinary texts may hold one odd word, hardly two."""
        parts = [windows(line) for line in lines]
        rows = np.repeat(np.arange(len(lines)), [len(p) for p in parts])
        gains = np.maximum(self.window_gains([w for p in parts for w in p]), 0)
        order = np.lexsort((-gains, rows))
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = order[place < 2]
        return np.minimum(np.bincount(rows[top], gains[top], len(lines)).astype(np.int64), MOST_GAIN)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at, curve = np.zeros(len(texts)), 0, np.array(self.curve)
        while at < len(texts):  # by bytes, so that memory holds
            lines, size = [], 0
            while at + len(lines) < len(texts) and (not lines or size < 1 << 20):
                lines.append(normal(texts[at + len(lines)]))
                size += len(lines[-1])
            out[at : at + len(lines)] = curve[self.gains(lines)]
            at += len(lines)
        return out


def _rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest rising values by weighted least squares (adjacent violators pooled)."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, n = blocks.pop()
            total = blocks[-1][1] + w
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * w) / total, total, blocks[-1][2] + n]
    return np.concatenate([[v] * n for v, _, n in blocks])


def fit_model(toxic: list[str], ordinary: list[str], toxic_rows: int | None = None, ordinary_rows: int | None = None) -> Model:
    """Train both dictionaries and calibrate; ``*_rows`` are the labelled rows that the samples stand for."""
    bad, good = (without_copies([normal(t) for t in texts]) for texts in (toxic, ordinary))
    segments = contrast(bad, good)
    told = tuple(segments)
    often = [Counter(w for line in lines for w in set(line.split())) for lines in (bad, good)]
    whole = [b" " + w + b" " for w, n in sorted(often[0].items(), key=lambda x: (x[1], x[0])) if told and n > 1 + 2 * often[1][w] and (b" " + w + b" ").startswith(told)]
    own = b"\x01".join([*[w for w in whole if w not in told], *reversed(segments), b""])[-TOXIC_BYTES:]
    model = Model(b"", own, [0.0] * (MOST_GAIN + 1))
    for _ in range(ROUNDS if own else 0):  # ordinary words that look toxic go into the ordinary dictionary
        likely: Counter = Counter()
        for at in range(0, len(good), 400):  # half of them teach, the others calibrate
            parts = [w for line in good[at : at + 400 : 2] for w in windows(line)]
            likely.update(x for w in np.flatnonzero(model.window_gains(parts) > 1) for x in parts[w][: -len(TAIL)].split())
        words = sorted(likely, key=lambda x: (-likely[x], x))[:20_000]
        looks = model.window_gains([b" " + w + b" " + TAIL for w in words])
        hard = [b" " + w + b" " for w, gain in zip(words, looks, strict=True) if gain > 0 and not (b" " + w + b" ").startswith(told)][: ORDINARY_BYTES // 64]
        if not hard:
            break
        model = Model((b"".join(reversed(hard)) + model.shared)[-ORDINARY_BYTES:], own, model.curve)
    counts = np.full((2, MOST_GAIN + 1), 0.0)
    for label, lines, rows in ((1, bad, toxic_rows), (0, good[1::2] or good, ordinary_rows)):
        each = (rows or len(bad if label else good)) / max(1, len(lines))
        for at in range(0, len(lines), 200):
            np.add.at(counts[label], model.gains(lines[at : at + 200]), each)
    total = counts.sum(axis=0)
    rate = counts[1].sum() / max(1.0, counts.sum())
    smooth = (counts[1] + rate) / (total + 1.0)
    seen = np.flatnonzero(total)
    if len(seen):  # gains that no labelled text has lie between those around them
        model.curve = np.clip(np.interp(np.arange(MOST_GAIN + 1), seen, _rising(smooth[seen], total[seen])), 0.0, 1.0).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled documents, at most about TOXIC_SAMPLE and ORDINARY_SAMPLE, drawn by a hash of the id.

    The draw is made on ids and labels alone; texts are read for the drawn ids only. Rows with a null label or id, texts of
    over FIT_CHARS characters and null texts are not learned from. Without any, every score is zero.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumnRenamed("doc_id", "labelled").where(train if train is not None else F.lit(True))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return Model(b"", b"", [0.0] * (MOST_GAIN + 1))
    rate = F.when(F.col("toxic") == 1, TOXIC_SAMPLE / counts[1]).otherwise(ORDINARY_SAMPLE / max(1, counts.get(0, 0)))
    drawn = marks.where(uniform("labelled", seed=6) < rate)
    rows = docs.select(F.col(doc_id).alias("labelled"), F.col(text).alias("text")).where(F.length("text") <= FIT_CHARS)
    found = rows.join(F.broadcast(drawn), "labelled").collect()  # drawn is bounded by the two samples
    rows = sorted((r["labelled"], r["toxic"], r["text"]) for r in found)
    return fit_model([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], counts.get(1, 0), counts.get(0, 0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as struct ``d`` with ``score``, the probability of the toxic label, from all windows of the text.

    Null and empty texts have no window and get the probability of gain zero. No shuffle; the model is a few kilobytes. Each row is scored by itself:
    repeated rows get equal scores, rows with a null id and columns of any name pass through, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.shared, model.toxic, model.curve))

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for texts in parts:
            yield pd.Series(own.scores(list(texts)))
        release()

    return docs.select(F.struct("*").alias("d"), scores(F.col(text)).alias("score"))
