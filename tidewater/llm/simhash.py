"""SimHash near-duplicate detection with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most two bits, then by the pigeonhole
principle some segment agrees exactly while the next one (cyclically) differs in at most one bit, or two segments agree.
The next segment is decoded with the perfect binary Golay code (23, 12, 7): its nearest codeword, and for words at
distance three also the five codewords at distance four. Two segments that differ in one bit share at least one of these
codeword indices, so (exact segment, codeword index) is a key on which all links meet.

Texts that are similar but not that close are found with a wider fingerprint: each of many draws of its bits is decoded to its
nearest codeword, which several errors leave in place, and that index with a few exact bits is a key. Texts that meet on a
key, with fingerprints not too far apart, form coarse groups, inside which the similarity of whole shingle sets is verified
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches, release
from tidewater.llm.vectors import groups
from tidewater.operators.graph import connected_components
from tidewater.sources.shared import drop_path, new_path, written

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
#: (lowest bit, bits) of the segments; each fits the code's 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of more fingerprints than this are linked through shared midpoints, not by comparing their pairs.
PAIR_BUCKET = 64
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a whole text; zero without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z fold, only \x20 \x09-\x0D split
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        some = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _remainders() -> np.ndarray:
    """Remainder of each 12-bit high part and of each 11-bit low part modulo the generator, for XOR."""
    table = np.zeros(1 << 12, np.int32)
    for high in range(1 << 12):
        value = high << 11
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        table[high] = value
    return table


def _patterns(remainders: np.ndarray) -> np.ndarray:
    """For each syndrome up to six error patterns: the one of at most three bits, then those of four bits; -1 if none."""
    of_bit = [int(remainders[1 << (i - 11)]) if i >= 11 else 1 << i for i in range(23)]
    out, used, leader = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= of_bit[i]
            if weight < 4:
                leader[syndrome] = weight
            elif leader[syndrome] != 3:
                continue
            out[syndrome, used[syndrome]] = sum(1 << i for i in bits)
            used[syndrome] += 1
    return out


_TABLES: dict[str, np.ndarray] = {}


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each 23-bit word; -1 where there are fewer."""
    if not _TABLES:
        _TABLES["remainder"] = _remainders()
        _TABLES["pattern"] = _patterns(_TABLES["remainder"])
    syndromes = _TABLES["remainder"][words >> 11] ^ (words & 0x7FF)
    errors = _TABLES["pattern"][syndromes]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(prints: pd.Series) -> pd.Series:
    values = prints.to_numpy(np.int64).view(np.uint64)
    parts = [((values >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    keys = []
    for i in range(3):
        near = golay_indices(parts[(i + 1) % 3])
        keys.append(np.where(near >= 0, (i << 40) | (parts[i][:, None] << 12) | near, -1))
    return pd.Series([row[row >= 0] for row in np.concatenate(keys, axis=1)])


def near_links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between representatives whose fingerprints differ in one or two bits.

    ``prints`` has distinct ``fp`` and their ``rep``. Connectivity is complete: small buckets give every link; a bucket of
    more than PAIR_BUCKET fingerprints gives for each midpoint (a fingerprint or one with a flipped bit) a star over
    those within one bit of it, which are all linked with each other.
    """
    keyed = written(prints.where("rep is not null").withColumn("k", F.explode(_keys("fp"))), "keys")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1")
    sizes = written(sizes, "buckets")
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2
    pairs = sizes.where("n = 2").where(close).select("x", "y").distinct()
    some = keyed.join(sizes.where(f"n between 3 and {PAIR_BUCKET}").select("k"), "k").select("k", "fp")
    more = some.withColumnRenamed("fp", "x").join(some.withColumnRenamed("fp", "y"), "k").where("x < y").where(close).select("x", "y")
    pairs = pairs.unionByName(more).distinct()
    reps = prints.select("fp", "rep")
    edges = (
        pairs.join(reps.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x")
        .join(reps.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y")
        .select("a", "b")
    )
    hot = keyed.join(sizes.where(f"n > {PAIR_BUCKET}").select("k"), "k").select("fp", "rep").distinct()
    flips = F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")
    around = hot.select("rep", F.explode(flips).alias("mid"))
    stars = around.groupBy("mid").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    return edges.unionByName(around.join(stars, "mid").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp (long), component_id`` for each row.

    Rows without words (null or blank text) have fingerprint zero and link like any other. Equal fingerprints are
    collapsed before any search. Rows with a null id have a fingerprint and take part in no link: their component is that
    of their fingerprint, null if no row with an id has it. Repeated rows give repeated rows. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    each = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), _fingerprints(F.col(text)).alias("fp")), "prints")
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    components = connected_components(near_links(classes))
    named = classes.join(components, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(written(named, "named"), "fp").select("doc_id", "fp", "component_id")


def hex_print(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# Copies by similarity ---------------------------------------------------------------------------------------------

#: Fixed values of near copies: words of a shingle, least Jaccard similarity in percent.
WORDS = 5
PERCENT = 80
#: Chance that two texts of just that similarity differ in a fingerprint bit (the angle of their shingle vectors over pi), and that
#: 23 such bits decode to one codeword.
BIT_CHANGES = 0.1515
SAME_CODEWORD = 0.1214
#: Chance that such a pair shares no key at all.
MISS = 0.01
#: Of a fingerprint's first 128 bits those in which such a pair may differ: over three standard deviations above their mean.
MOST_BITS = 34
#: Rows of a bucket that are compared with each other; a larger one is a coarse group as a whole. Texts compared in one block.
NEXT_ROWS = 64
BLOCK = 256
#: Edges that a task holds at most.
FOREST_ROWS = 1_000_000
#: Bits of a filter that keeps rows which are surely kept from being shuffled; a full one lets all through.
FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class Draws:
    """How wide fingerprints become keys: ``tables`` draws of 23 bits for the code and ``extra`` exact ones of ``bits``."""

    bits: int
    tables: int
    extra: int

    @classmethod
    def of(cls, texts: int) -> Draws:
        """Buckets hold a few texts each at any number of texts; tables keep the chance of a miss."""
        extra = max(4, int(texts).bit_length() - 14)
        tables = int(np.ceil(np.log(1 / MISS) / (SAME_CODEWORD * (1 - BIT_CHANGES) ** extra)))
        return cls(64 * max(8, -(-tables * (23 + extra) // 256)), tables, extra)

    def places(self) -> np.ndarray:
        rng = np.random.default_rng(2)
        return np.array([rng.choice(self.bits, 23 + self.extra, replace=False) for _ in range(self.tables)])

    def keys(self, bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        """``(texts, tables)`` keys of rows of 0 and 1."""
        drawn = bits[:, places].astype(np.int64)
        code = golay_indices((drawn[:, :, :23] << np.arange(23)).sum(axis=2).ravel())[:, 0].reshape(len(bits), -1)
        exact = (drawn[:, :, 23:] << np.arange(self.extra)).sum(axis=2)
        return (np.arange(self.tables) << (12 + self.extra)) | (code << self.extra) | exact


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles in order; a text of fewer words is one shingle, one without words none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    width = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def wide_bits(own: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash of a set of shingles in ``bits`` bits, as 0 and 1; the first 64 are those of the hashes themselves."""
    ones = np.zeros(bits, np.int64)
    steps = np.arange(bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] + steps[None, :]
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return (ones * 2 > len(own)).astype(np.uint8)


def _sketches(draws: Draws, words: int):
    @F.pandas_udf("id long, n int, fp long, more long, keys array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places = draws.places()
        for texts in parts:
            texts = list(texts)
            for_all: list[pd.DataFrame] = []
            for at in range(0, len(texts), 256):
                sets = [shingles(t, words) for t in texts[at : at + 256]]
                bits = np.array([wide_bits(s, draws.bits) for s in sets])
                for_all.append(pd.DataFrame({
                    "id": [xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "n": [len(s) for s in sets],
                    "fp": np.packbits(bits[:, :64], axis=1).view(np.int64).ravel(), "more": np.packbits(bits[:, 64:128], axis=1).view(np.int64).ravel(), "keys": list(draws.keys(bits, places)),
                }).astype({"id": "uint64"}))
            out = pd.concat(for_all) if for_all else pd.DataFrame({"id": np.zeros(0, np.uint64), "n": [], "fp": [], "more": [], "keys": []})
            out["id"] = out["id"].to_numpy(np.uint64).view(np.int64)
            yield out
        release()

    return of


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Each id of the pairs with the least id that it hangs together with: one edge an id, however many pairs there are."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[label[hung]], "b": nodes[hung]})


def _forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as one forest, so that an id has one edge; of very many edges, as several."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > FOREST_ROWS:
            held = [_forest(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in ("a", "b")))]
            size = len(held[0])
            if 2 * size > FOREST_ROWS:
                yield held[0]
                held, size = [], 0
    if held:
        yield _forest(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in ("a", "b")))
    release()


def _meetings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges that join a bucket's rows near in order and in fingerprint; a bucket of more than NEXT_ROWS rows is joined as a whole."""
    held = {c: np.zeros(0, np.int64) for c in ("k", "id", "fp", "more")}
    before, first = 0, 0  # rows of the last bucket that came before the held ones, and its first id
    for part in parts:
        if not len(part):
            continue
        now = {c: np.concatenate([held[c], part[c].to_numpy(np.int64)]) for c in held}
        k, ids, fp, more, old = now["k"], now["id"], now["fp"].view(np.uint64), now["more"].view(np.uint64), len(held["k"])
        start = np.concatenate(([True], k[1:] != k[:-1]))
        heads = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
        place = np.arange(len(k)) - heads + np.where(heads == 0, before, 0)
        head_id = np.where((heads == 0) & (before > 0), first, ids[heads])
        a, b = [], []
        for shift in range(1, NEXT_ROWS):
            at = np.arange(max(0, old - shift), len(k) - shift)
            at = at[k[at] == k[at + shift]]
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) + np.bitwise_count(more[at] ^ more[at + shift]) <= MOST_BITS]
            a.append(ids[at])
            b.append(ids[at + shift])
        fresh = np.arange(len(k)) >= old
        full = np.flatnonzero(fresh & (place == NEXT_ROWS))  # with the 64th the bucket becomes a star, those before with it
        star = np.concatenate([np.flatnonzero(fresh & (place >= NEXT_ROWS)), *[np.arange(max(heads[i], i - NEXT_ROWS), i) for i in full]]).astype(np.int64)
        a.append(head_id[star])
        b.append(ids[star])
        yield _forest(np.concatenate(a), np.concatenate(b))
        low = max(heads[-1], len(k) - NEXT_ROWS)
        before, first = int(place[-1]) - (len(k) - 1 - low), int(head_id[-1])
        held = {c: now[c][low:] for c in now}


def _roots(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric relation."""
    root = np.arange(len(near))
    while True:
        least = np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``percent``, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    rows, code = rows[counts[code] > 1], code[counts[code] > 1]  # those of one set are in no intersection
    shared = np.zeros((len(sets), len(sets)))
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
        low, high = np.searchsorted(code, (at, at + 8192))
        there = np.zeros((len(sets), 8192), np.float32)
        there[rows[low:high], code[low:high] - at] = 1
        shared += there @ there.T
    near = shared * 100 >= (sizes[:, None] + sizes[None, :] - shared) * percent
    np.fill_diagonal(near, False)
    return near


def _sets(words: int, passes):
    """Shingle sets of the texts whose mark passes; one function, so that one Python worker serves a task."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, marks in parts:
            yield pd.Series([shingles(t, words).tobytes() if ok else None for t, ok in zip(texts, passes(marks), strict=True)], dtype=object)
        release()

    return of


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: texts of one coarse group that similar ones join, every pair of a group compared once, block by block.

    ``members`` has ``component, blocks, id, shingles``. A group of more than BLOCK texts is dealt to blocks, and each block meets
    each other in a task of its own. What a block finds is given as one edge for each text that it joins, not as all pairs.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "shingles")
    keys = ["component", "p", "q"]

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(parts, keys):
            ids = group["id"].to_numpy()
            root = _roots(similar([np.frombuffer(x, np.uint64) for x in group["shingles"]], percent))
            joined = root != np.arange(len(root))
            if joined.any():
                yield pd.DataFrame({"a": ids[root[joined]], "b": ids[joined]})
        release()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def _filter(values: DataFrame):
    """A test of bounded size that every long of the one column passes, and few others while it is not full."""
    column = F.pmod(F.col(values.columns[0]), F.lit(FILTER_BITS))
    parts = values.select(F.shiftright(column, 15).alias("b"), column.bitwiseAND(F.lit((1 << 15) - 1)).alias("p"))
    held = np.zeros(FILTER_BITS, bool)
    for r in parts.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():  # at most FILTER_BITS / 2^15 rows
        held[r["b"] << 15 : r["b"] + 1 << 15] = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
    sent = values.sparkSession.sparkContext.broadcast(np.packbits(held))

    def passes(x: pd.Series) -> pd.Series:
        at = x.to_numpy(np.int64) % FILTER_BITS
        return pd.Series((sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return passes


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, mark, times, component`` for each distinct row: components of texts linked by a similarity of ``percent`` or more.

    ``mark`` is a hash of the whole row and ``times`` how often it stands there. Equal shingle sets are collapsed before any
    search; texts without words are copies of each other. A link whose texts share no key is missed unless others join them (MISS
    for a pair just at the threshold, far less above); no link of less similarity is made.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = new_path(spark, "sketches")
    mark = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    sketch = _sketches(Draws.of(docs.count()), words)
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark.alias("mark"), sketch(F.col(text)).alias("s")).select("doc_id", "mark", "s.*")
    each = written(each, "sketches", path)
    classes = each.where("n > 0").select("id", "fp", "more", "keys").dropDuplicates(["id"])
    keyed = classes.select(F.explode("keys").alias("k"), "id", "fp", "more")
    met = keyed.repartition("k").sortWithinPartitions("k", "fp").mapInPandas(lambda parts: _forests(_meetings(parts)), "a long, b long")
    met = met.repartition("b").mapInPandas(_forests, "a long, b long")  # the trees that an id is in become one
    coarse = written(connected_components(met), "coarse")
    rows = written(each.groupBy("id", "doc_id", "mark").agg(F.count("*").alias("times")), "rows")
    drop_path(spark, path)
    wanted = rows.join(coarse, F.col("id") == F.col("node")).groupBy("component", "id").agg(F.min(F.struct("mark", "times")).alias("m"))
    sizes = coarse.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = written(wanted.join(sizes, "component").select("component", "blocks", "id", "m.mark", "m.times"), "wanted")
    sets = _sets(words, _filter(wanted.select("mark")))
    members = docs.select(F.col(text).alias("t"), mark.alias("mark")).select("mark", sets("t", "mark").alias("shingles")).where("shingles is not null").join(wanted, "mark").select("component", "blocks", "id", "times", "shingles")
    members = members.where("times = 1").unionByName(members.where("times > 1").dropDuplicates(["id"]))
    found = written(connected_components(_verified(members, percent)), "found")
    named = rows.join(found, F.col("id") == F.col("node"), "left").select("doc_id", "mark", "times", F.coalesce("component", "id").alias("component"))
    return written(named, "named")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of similar texts, the one with the smallest id; see similar_components.

    Rows without id link like any other and come after those with one; rows of one id are told apart by a hash of the whole
    row, and of fully equal rows one is kept.
    """
    rows = similar_components(docs, doc_id, text, words, percent)
    mark = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    rows = rows.withColumn("rank", rank)
    best = rows.groupBy("component").agg(F.min("rank").alias("best"))
    gone = rows.join(best, "component").where("rank <> best or times > 1").select("mark", (F.col("rank") == F.col("best")).alias("once"))
    gone = written(gone, "gone")
    marked = docs.select(F.struct("*").alias("d"), mark.alias("mark"))
    maybe = F.pandas_udf(_filter(gone.select("mark")), T.BooleanType())
    kept = marked.where(~maybe("mark")).select("d.*")
    kept = kept.unionByName(marked.where(maybe("mark")).join(gone.select("mark"), "mark", "left_anti").select("d.*"))
    once = marked.join(gone.where("once").select("mark"), "mark", "left_semi").groupBy("mark").agg(F.first("d").alias("d"))
    return kept.unionByName(once.select("d.*"))
