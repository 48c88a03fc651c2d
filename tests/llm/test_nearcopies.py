"""The pipeline's removal of near copies against a plain comparison of all pairs."""

import random

import numpy as np

import corpus_pipeline
from tidewater.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(rows, words=5, least=0.8):
    def of(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets, root = [of(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def test_dedup_stage_near_copies_repeated_and_unnamed_rows(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(60)], []
    for _ in range(12):
        text = [word() for _ in range(rng.choice((6, 40, 230)))]
        for edits in (0, 0, 1, 2, 4, 7):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "en", "s", len(copy)))
    rows += [(500 + i, " ".join(passage + [word() for _ in range(20 + i % 7)]), "en", "s", i) for i in range(40)]
    rows += [(3, rows[3][1], "en", "s", rows[3][4]), (900, "one id two texts", "en", "s", 1), (900, "another text of this id here", "en", "s", 1)]
    rows += [(901, "repeated row", "en", "s", 1)] * 2 + [(None, "no id " * 9, "en", "s", i % 2) for i in range(4)] + [(None, "alone without id", "en", None, None)]
    of = plain_components(rows)
    kept = [tuple(r) for r in corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    least = {}
    for row, c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, (True, 0)), (row[0] is None, row[0] or 0))
    assert len(kept) == len(least) and {r for r in kept} <= set(rows)
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(least.values())


def test_similar_sets_are_those_of_plain_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    plain = [set(s.tolist()) for s in sets]
    near = simhash.similar(sets, 50)
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert near[i, j] == (i != j and 2 * len(a & b) >= len(a | b))


def test_pairs_at_the_threshold_share_a_key():
    """Of pairs of sets with a similarity of just 0.8 at most a few in a hundred share no key or differ in too many bits."""
    rng, draws = np.random.default_rng(7), simhash.Draws.of(50_000)
    places, missed = draws.places(), 0
    for _ in range(150):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = (simhash.wide_bits(x, draws.bits) for x in (pool[:240], np.concatenate([pool[26:240], pool[240:267]])))
        keys = draws.keys(np.array([a, b]), places)
        missed += not (keys[0] == keys[1]).any() or (a[:128] != b[:128]).sum() > simhash.MOST_BITS
    assert missed <= 8


def test_buckets_in_pieces_join_the_same_rows():
    """However a bucket is cut into batches, rows with near fingerprints meet, and a large bucket hangs together."""
    import pandas as pd

    rng = np.random.default_rng(8)
    k = np.sort(np.concatenate([rng.integers(0, 30, 200), np.full(300, 30), rng.integers(31, 60, 100)]))
    fp = rng.integers(0, 1 << 62, len(k))
    fp[::3] = fp[0] ^ (1 << rng.integers(0, 62, len(fp[::3])))
    rows = pd.DataFrame({"k": k, "id": np.arange(len(k)), "fp": fp, "more": fp[0]}).sort_values(["k", "fp"])
    for size in (1000, 70, 7):
        found = pd.concat(simhash._meetings(iter([rows.iloc[at : at + size] for at in range(0, len(rows), size)])))
        root = dict(zip(range(len(k)), range(len(k)), strict=True))
        top = lambda x: x if root[x] == x else top(root[x])
        for a, b in zip(found["a"], found["b"], strict=True):
            root[max(top(a), top(b))] = min(top(a), top(b))
        hot = rows[rows["k"] == 30]["id"].tolist()
        assert len({top(x) for x in hot}) == 1
        for _, own in rows[rows["k"] != 30].groupby("k"):
            prints = dict(zip(own["id"].tolist(), own["fp"].tolist(), strict=True))
            true = {i: i for i in prints}
            for _ in prints:
                true = {i: min(true[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= simhash.MOST_BITS) for i in prints}
            assert len({(true[i], top(i)) for i in prints}) == len(set(true.values())) == len({top(i) for i in prints})
