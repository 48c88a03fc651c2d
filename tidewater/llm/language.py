"""Language identification by string-kernel classification.

A text is the set of its character n-grams of several lengths (a blended spectrum, presence only). The kernel of two texts
is the cosine of these sets. Landmark texts from each language give a Nyström approximation; one-versus-rest kernel ridge
regression is solved on it, and since the kernel with a landmark is a product of presence vectors, landmarks and ridge
coefficients fold into one matrix by which batches of presence vectors are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, release, uniform
from tidewater.sources.shared import written

ORDERS = (2, 3, 4)
#: Bounds of the fit: texts of each language and of all, landmarks of each language, characters of a text used for fitting.
PER_LANGUAGE = 400
ALL_TEXTS = 20_000
LANDMARKS = 40
FIT_CHARS = 20_000
RIDGE = 1e-3
#: Sharpness of the softmax that turns regression values into a score.
SHARPNESS = 4.0
SLICE = 1 << 18
#: Cells of one presence matrix, at most: 128 MB.
CELLS = 1 << 25
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SLOT_BITS = 20


def _letters() -> np.ndarray:
    """For each 16-bit character: itself if a letter, else a space."""
    return np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _characters(text: str) -> np.ndarray:
    if "letters" not in _CACHE:
        _CACHE["letters"] = _letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _CACHE["letters"][np.minimum(points, 0xFFFF) if len(points) and points.max() > 0xFFFF else points]


def _codes(characters: np.ndarray, order: int) -> np.ndarray:
    """Exact numbers of the n-grams, 16 bits a character."""
    n = len(characters) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = characters[:n].copy()
    for i in range(1, order):
        code = (code << np.uint64(16)) | characters[i : n + i]
    return code


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # distinct n-gram numbers of the landmarks
    weights: np.ndarray  # (n-grams, languages)
    slots: list[np.ndarray] = field(default_factory=list)
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        left = np.arange(len(self.grams))
        for multiplier in _MULTIPLIERS:  # what a slot has no room for goes to the next table
            slot = (self.grams[left] * np.uint64(multiplier)) >> np.uint64(64 - _SLOT_BITS)
            table = np.full(1 << _SLOT_BITS, -1, np.int32)
            table[slot] = left
            self.slots.append(table)
            left = left[table[slot] != left]
        self.rest = left[np.argsort(self.grams[left])]  # no room in any table: searched by order

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``codes`` whose n-gram a landmark has, and its number."""
        at, found = [], []
        where = np.arange(len(codes))
        for multiplier, table in zip(_MULTIPLIERS, self.slots, strict=True):
            hit = table[(codes * np.uint64(multiplier)) >> np.uint64(64 - _SLOT_BITS)]
            same = (hit >= 0) & (self.grams[hit] == codes)
            at.append(where[same])
            found.append(hit[same])
            other = (hit >= 0) & ~same  # an empty slot in this table: no landmark has it
            where, codes = where[other], codes[other]
            if not len(codes):
                break
        if len(codes) and len(self.rest):
            order = self.grams[self.rest]
            place = np.minimum(np.searchsorted(order, codes), len(order) - 1)
            same = order[place] == codes
            at.append(where[same])
            found.append(self.rest[place[same]])
        return np.concatenate(at), np.concatenate(found)

    def features(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Batches ``(first, end, presence matrix)`` with rows of length one (zero without a known n-gram)."""
        first, most = 0, max(1, min(128, CELLS // max(1, len(self.grams))))
        while first < len(texts):
            end, size = first, 0
            while end < len(texts) and (end == first or (size + len(texts[end]) <= SLICE and end - first < most)):
                size += len(texts[end])
                end += 1
            matrix = np.zeros((end - first, len(self.grams)), np.float32)
            pieces = [(i, t[at : at + SLICE + max(ORDERS) - 1]) for i, t in enumerate(texts[first:end]) for at in range(0, max(1, len(t)), SLICE)]
            for group in self._grouped(pieces):
                rows = np.repeat([i for i, _ in group], [len(t) for _, t in group])
                characters = _characters("".join(t for _, t in group))
                if len(characters) != len(rows):  # lower-casing changed a length
                    parts = [_characters(t) for _, t in group]
                    characters, rows = np.concatenate(parts), np.repeat([i for i, _ in group], [len(p) for p in parts])
                for order in ORDERS:
                    codes = _codes(characters, order)
                    at, found = self.find(codes)
                    inside = rows[at] == rows[at + order - 1]
                    matrix[rows[at][inside], found[inside]] = 1
            norms = np.sqrt(matrix.sum(axis=1, keepdims=True))
            yield first, end, np.divide(matrix, norms, out=matrix, where=norms > 0)
            first = end

    @staticmethod
    def _grouped(pieces: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
        group, size = [], 0
        for piece in pieces:
            if group and size + len(piece[1]) > 2 * SLICE:
                yield group
                group, size = [], 0
            group.append(piece)
            size += len(piece[1])
        if group:
            yield group

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        whole = [t or "" for t in texts]
        labels, scores = ["und"] * len(whole), [0.0] * len(whole)
        for first, end, matrix in self.features(whole):
            values = matrix @ self.weights
            odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            best, seen = odds.argmax(axis=1), matrix.any(axis=1)
            for i in range(first, end):
                if has_letters(whole[i]):
                    labels[i] = self.languages[best[i - first]]
                    scores[i] = float(odds[i - first, best[i - first]]) if seen[i - first] else 0.0
        return labels, scores


def fit_model(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on ``(language, text)`` rows; the first of each language are its landmarks."""
    languages = sorted({lang for lang, _ in sample})
    chosen: list[str] = []
    for lang in languages:
        chosen += [t for own, t in sample if own == lang][:landmarks]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.unique(_codes(_characters(t), n)) for t in chosen for n in ORDERS]))
    model = Model(languages, grams, np.zeros((len(grams), len(languages)), np.float32))
    if not languages or not len(grams):
        return model
    z = np.concatenate([m.copy() for _, _, m in model.features(chosen)]).astype(np.float64)
    k_nm = np.concatenate([m @ z.T.astype(np.float32) for _, _, m in model.features([t for _, t in sample])]).astype(np.float64)
    y = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    k_mm = z @ z.T
    left = k_nm.T @ k_nm + ridge * len(sample) * k_mm + 1e-9 * np.eye(len(chosen))
    model.weights = (z.T @ np.linalg.solve(left, k_nm.T @ y)).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, text: str, lang: str, train: Column | None, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The ``per_language`` labelled texts of each language with the smallest draws by a hash of the text, in a fixed order.

    More than ALL_TEXTS / ``per_language`` languages share ALL_TEXTS evenly, so the sample is bounded whatever the labels. Copies count as one text, so a language has all its texts in the sample up to that number. Of a text of more than
    FIT_CHARS characters a piece of that length stands for it, from a place drawn by another hash.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), (train if train is not None else F.lit(True)).alias("train"))
    rows = rows.where("train and lang is not null and length(text) > 0").withColumn("draw", uniform(F.col("text"), seed=4))
    draws = written(rows.select("lang", "draw").distinct(), "draws")
    counts = {r["lang"]: r["n"] for r in draws.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, ALL_TEXTS // len(counts)))
    by_lang = lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), F.col("lang"))
    few = draws.where(F.col("draw") <= by_lang({own: min(1.0, (2.0 * per_language + 100) / n) for own, n in counts.items()})).collect()
    cuts = {own: sorted(r["draw"] for r in few if r["lang"] == own)[:per_language][-1] for own in counts}
    start = F.floor(uniform(F.col("text"), seed=5) * F.greatest(F.length("text") - FIT_CHARS, F.lit(0))).cast("int") + 1
    piece = F.substring(F.col("text"), start, F.lit(FIT_CHARS)).alias("text")
    drawn = rows.where(F.col("draw") <= by_lang(cuts)).select("lang", piece, "draw").distinct().collect()
    ordered = sorted((r["lang"], r["draw"], r["text"]) for r in drawn)
    return [(lang, text) for lang, _, text in ordered]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as struct ``d`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts, without a shuffle.

    Text that is null or has no letters is ``und`` with score 0; text with letters but no n-gram of any landmark gets the
    first learned language with score 0. The model is sent to executors once; its size is bounded by the landmarks. Each row is judged by itself: repeated
    rows get equal results, rows with a null id and columns of any name pass through, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.languages, model.grams, model.weights))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for texts in parts:
            labels, scores = own.predict(list(texts)) if own.languages else (["und"] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": labels, "score": scores})
        release()

    return docs.select(F.struct("*").alias("d"), predict(F.col(text)).alias("p")).select("d", "p.lang_pred", "p.score")


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang") -> Model:
    return fit_model(labelled_sample(docs, text, lang, train))
