"""Similarity joins, samples, twins and the audit sink against plain versions."""

import datetime as dt
import hashlib
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewater.operators import evaluate, graph, messages
from tidewater.operators import quality as Q


def _texts(seed=2, n=400):
    """Sets of words that all share one word, with near copies."""
    draw, texts = random.Random(seed), []
    for i in range(n):
        words = draw.choice(texts).split()[1:] if texts and draw.random() < 0.6 else [f"w{draw.randrange(300)}" for _ in range(draw.randint(1, 12))]
        words = [w if draw.random() < 0.93 else f"w{draw.randrange(300)}" for w in words]
        texts.append(" ".join(["all", *words]))
    return texts


def _plain_pairs(texts, threshold):
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(t.split()), f"m{i:04d}")
    items = sorted((rep, s) for s, rep in sets.items())
    return {(a, b, round(len(x & y) / len(x | y), 6)) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if len(x & y) / len(x | y) >= threshold}


@pytest.mark.parametrize("block", [messages.BLOCK, 7])
def test_similarity_join_is_exact_in_blocks(spark, block):
    texts = _texts()
    df = spark.createDataFrame([(f"m{i:04d}", t) for i, t in enumerate(texts)], "id string, text string")
    expected = _plain_pairs(texts, 0.6)
    assert {tuple(r) for r in messages.near_duplicate_pairs(df, 0.6, block=block).collect()} == expected and len(expected) > 100
    only = spark.createDataFrame([(f"m{i:04d}", "all one") if i % 2 else (f"m{i:04d}", "all") for i in range(60)], "id string, text string")
    assert messages.near_duplicate_pairs(only, 0.5, block=2).count() == 1


def test_no_cell_holds_a_hot_bucket(spark):
    rows = spark.range(2000).select(F.format_string("m%05d", "id").alias("rep"), F.lit(3).alias("n"), F.lit("hot").alias("bucket"))
    assert messages.met_in_buckets(rows, 0.6, block=100).count() == 2000 * 1999 // 2
    assert messages.met_in_buckets(rows, 0.6, block=100, sent=0).count() == 2000 * 1999 // 2


def test_minhash_recall(spark):
    texts = _texts(3, 600)
    df = spark.createDataFrame([(f"m{i:04d}", t) for i, t in enumerate(texts)], "id string, text string")
    expected = _plain_pairs(texts, 0.6)
    found = {tuple(r) for r in messages.near_duplicate_pairs(df, 0.6, method="minhash").collect()}
    assert found <= expected and len(found) >= 0.99 * len(expected)


def test_components_of_names(spark):
    edges = [("a", "b"), ("c", "b"), ("x", "y")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["n040"] == "n000" and len(got) == 46


def _plain_sample(rows, n, least):
    order = lambda i: (hashlib.md5(i.encode()).hexdigest()[:13], i)
    chosen = [i for i, _, h in sorted(rows, key=lambda r: order(r[0])) if h][:n]
    label = {i: c for i, c, _ in rows}
    sizes, have = Counter(label.values()), Counter(label[i] for i in chosen)
    pools = {c: sorted((i for i in label if label[i] == c and i not in chosen), key=order) for c in sizes}
    for c in sorted(sizes):
        while have[c] < least and pools[c]:
            chosen.append(pools[c].pop(0))
            have[c] += 1
    while len(chosen) < n and any(pools.values()):
        _, c = max((sizes[c] / len(rows) * n - have[c], c) for c in sizes if pools[c])
        chosen.append(pools[c].pop(0))
        have[c] += 1
    return Counter(chosen[:n])


@pytest.mark.parametrize("n", [5, 40, 130, 500])
def test_hard_rows_first(spark, n):
    draw = random.Random(n)
    rows = [(f"m{i}", draw.choice("aaaaaaabbbccd") if i % 60 else "rare", draw.random() < 0.1) for i in range(300)]
    found = evaluate.hard_first_sample(spark.createDataFrame(rows, "id string, label string, h boolean"), "label", F.col("h"), n).collect()
    expected = _plain_sample(rows, n, 2)
    assert len(found) == min(n, 300) and (n == 5 or Counter(r["id"] for r in found) == expected)
    assert {r["id"] for r in found if r["tier"] == "hard"} <= {i for i, _, h in rows if h}


def test_twins_of_any_schema(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", D(1), t, ["x"], {"k": 1}), (1, "a", D(2), t, ["x"], {"k": 2}), (2, "b", None, t, ["x"], None), (2, "b", D(1), t, ["y"], None), (3, "c", None, None, None, None), (3, "c", None, None, None, None), (4, "d", D(1), t, [], {})]
    df = spark.createDataFrame(rows, "id int, `odd name` string, amount decimal(18,2), at timestamp_ntz, tags array<string>, more map<string,int>")
    got = {r["id"]: (r["n"], r["differing"]) for r in Q.twin_differences(df, ["id"]).collect()}
    assert got == {1: (2, ["amount", "more"]), 2: (2, ["amount", "tags"])}
    assert Q.counted_list(df, ["odd name"]).first()["listed"] == "a=2, b=2, c=2, d=1"
    assert Q.counted_list(df.where("false"), ["id"]).first()["listed"] == ""


def test_audit_sink_keeps_runs_and_replaces_reruns(spark):
    sink = Q.AuditSink(spark)
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    one = spark.createDataFrame([(1, D("1.50"), t, dt.date(2024, 1, 2), ["a"], None), (2, None, None, None, None, "x")], "id long, amount decimal(18,2), at timestamp_ntz, day date, tags array<string>, note string")
    two = spark.createDataFrame([("k", True)], "name string, `odd name` boolean")
    sink.write("monday", {"first": ("error", one), "second": ("warn", two)})
    sink.write("tuesday", {"first": ("error", one.where("id = 2")), "second": ("warn", two.where("false"))})
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(sink.rows("monday", "first", one.schema), one) and same(sink.rows("monday", "second", two.schema), two)
    assert sink.runs() == ["monday", "tuesday"] and sink.read().groupBy("run").count().orderBy("run").collect() == [("monday", 3), ("tuesday", 1)]
    sink.write("monday", {"first": ("error", one.where("id = 1"))})
    sink.write("monday", {"first": ("error", one.where("id = 1"))})
    assert same(sink.rows("monday", "first", one.schema), one.where("id = 1")) and sink.read("monday").count() == 1
    assert same(sink.rows("tuesday", "first", one.schema), one.where("id = 2")) and len(sink._versions("monday")) == 1
    sink.write("monday", {})
    assert sink.read("monday").count() == 0
