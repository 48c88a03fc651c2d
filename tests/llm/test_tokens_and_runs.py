"""Chunked BPE, alignment of tokenizers and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import alignment, chunked, periodic, queries
from tidewater.llm.tokenize import WordBpe

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    (1, None), (2, ""), (3, "the same text here"), (3, "the same text here"), (None, "no id at all"), (5, " \t\n"), (6, "x " * 40_000), (7, "日本語の文章です" * 900),
    (8, "abc" * 9000), (9, "<|endoftext|> <s> a<|startoftext|>" * 200), (10, "a▁b"), (11, "é́ ﬁ café  naïve\n\n \tend  "), (12, "Don't I'LL ΑΣΣ  x  y" * 300), (13, "\x00\x01 nul"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("d", "ids", "runs", "links", "n_a", "row", "cold", "name")])


@pytest.fixture(scope="module")
def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# 11


def plain_round_trip(rows):
    t = Tokenizer.from_file(WORDS)
    out = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return Counter(out)


def test_round_trip_query(spark, sample):
    assert Counter(map(tuple, queries.bpe_round_trip(spark, SF).collect())) == plain_round_trip(sample)


@pytest.mark.parametrize("sent", [0, 3000, chunked.SENT])
def test_round_trip_odd(spark, odd, sent):
    found = chunked.bpe_round_trip(odd, WORDS, sent=sent)
    got = found.select("d.doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert Counter(map(tuple, got)) == plain_round_trip(ODD)
    assert set(odd.columns) == set(found.select("d.*").columns)
    assert chunked.bpe_round_trip(odd.where("false"), WORDS, sent=sent).count() == 0


def test_joins_are_repaired():
    """Words without white space over many chunks, cut anywhere; again from kept chunks, with and without sent ones."""
    rng, t, encoder = random.Random(5), Tokenizer.from_file(WORDS), WordBpe(WORDS)
    texts = ["".join(rng.choice("ab éñ日́ <|>'s.1\n\t") for _ in range(rng.randint(1, 6000))) for _ in range(30)]
    texts += ["".join(rng.choice("abcdé") for _ in range(9000)), "<|endoftext|>" * 700]
    raw, kept = [x.encode() for x in texts], chunked.Kept()
    parts = [c for own in chunked.chunks(raw) for c in own]
    assert [b"".join(own) for own in chunked.chunks(raw)] == raw and max(map(len, parts)) <= chunked.LONGEST + 4
    sent = dict(zip(map(chunked.name_of, parts[::3]), chunked.records(encoder, parts[::3]), strict=True))
    for table in ({}, sent, {}):
        got = [np.frombuffer(x, "<u4").tolist() for x in chunked.encode(encoder, raw, table, kept)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_shared_passages_fall_into_equal_chunks(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    texts = [("".join(rng.choice("xyz ") for _ in range(50 * i)) + passage,) for i in range(5)]
    own = [set(x) for x in chunked.chunks([t[0].encode() for t in texts])]
    assert len(set.intersection(*own)) >= 0.8 * len(own[0])
    shared = chunked.shared_chunks(spark.createDataFrame(texts, "text string"), WORDS)
    assert shared.count() == len({r["name"] for r in shared.collect()}) >= 0.8 * len(own[0])


# 12


def plain_alignment(rows):
    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    byte = alignment.printable_bytes()
    of_a = {i: bytes(byte[c] for c in s) for s, i in a_side.get_vocab().items() if s != "<|endoftext|>"}
    each, total = [], Counter()
    for doc, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            raw_a = [of_a[i] for i in a]
            raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == whole == b"".join(raw_b):
                by_byte_a, by_byte_b = np.repeat(range(len(a)), [len(x) for x in raw_a]), np.repeat(range(len(b)), [len(x) for x in raw_b])
                links = [(a[i], b[j]) for i, j in sorted(set(zip(by_byte_a.tolist(), by_byte_b.tolist(), strict=True)))]
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                both = sorted(set(ends_a) & set(ends_b))
                for low, high in zip([0, *both], both, strict=False):
                    groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b))))
            else:
                a, b = [], []
        total.update(links)
        each.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return Counter((d, na, nb, ng, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), s) for d, na, nb, ng, x, s in each)


def test_alignment_query(spark, sample):
    short = [(d, t) for d, t in sample if t is None or len(t) < 2500]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is null or length(text) < 2500")
    expected = plain_alignment(short)
    for hot in (alignment.HOT, 2000, 0):
        got = alignment.alignment(docs, BYTES, PIECES, keep=["doc_id"], hot=hot)
        assert Counter(map(tuple, got.select("d.doc_id", *got.columns[1:]).collect())) == expected
    assert queries.token_alignment(spark, SF).count() == len(sample)


def test_alignment_odd(spark, odd):
    rows = [(d, t) for d, t in ODD if d not in (6, 7, 8)]
    for hot in (alignment.HOT, 5):
        got = alignment.alignment(odd.where("doc_id is null or doc_id not in (6, 7, 8)"), BYTES, PIECES, hot=hot)
        assert Counter(map(tuple, got.select("d.doc_id", *got.columns[1:]).collect())) == plain_alignment(rows)
    long = alignment.alignment(odd.where("doc_id in (6, 7, 8)"), BYTES, PIECES).collect()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] > 0 for r in long)
    assert alignment.alignment(odd.where("false"), BYTES, PIECES).count() == 0


def test_gallop():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes, longer_sizes = rng.integers(0, 60, 12), rng.integers(1, 300, 12)
        longer, shorter, at = [], [], 0
        for s, m in zip(sizes, longer_sizes, strict=True):
            own = np.sort(rng.choice(1000, m, replace=False)) + at
            longer.append(own)
            shorter.append(np.sort(rng.choice(own[-1] - at + 1, min(s, own[-1] - at + 1), replace=False)) + at)
            at += 1000
        counts = np.array([len(x) for x in shorter])
        assert (alignment.ranks(np.concatenate(shorter), np.concatenate(longer), counts, longer_sizes) == np.searchsorted(np.concatenate(longer), np.concatenate(shorter))).all()


# 13


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n, s = j - i + q, w[i : j + q]
            if j > i and n >= max(6, 4 * q) and not any(s[d:] == s[: n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_random():
    rng, found = random.Random(2), 0
    for k in range(1500):
        size = rng.randint(0, 70)
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(size)] if k % 2 else []
        while len(w) < size:
            w += [rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        expected = plain_runs(w)
        found += len(expected)
        assert periodic.runs_of([x + 1 for x in w]) == expected
        texts = [None, " ".join(map(str, w)), "a b c " * 5, "", " ".join(map(str, w[::-1]))]
        assert [periodic.scan(texts)[0][i] for i in (1, 4)] == [expected, plain_runs(w[::-1])]
    assert found > 1000


def test_runs_query(spark, sample):
    got = queries.periodic_runs(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(d, t) for d, t in sample)
    assert sum(r["n_runs"] for r in got) > 5


def test_runs_odd(spark, odd):
    rows = [(d, t) for d, t in ODD if d != 6]
    got = periodic.periodic_runs(queries.with_planted_run(odd.where("doc_id is null or doc_id <> 6")))
    assert Counter((r["d"]["doc_id"], r["collapsed"]) for r in got.collect()).total() == len(rows)
    hashed = {(r["d"]["doc_id"], hashlib.sha256(r["collapsed"].encode()).hexdigest()) for r in got.collect()}
    assert hashed == {(r[0], r[-1]) for r in (plain_row(d, t) for d, t in rows)}
    long = periodic.periodic_runs(odd.where("doc_id = 6")).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 40_000, 1)] and long["collapsed"] == "x"
    assert set(odd.columns) == set(long["d"].asDict())
    assert periodic.periodic_runs(odd.where("false")).count() == 0
