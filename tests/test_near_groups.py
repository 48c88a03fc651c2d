"""Groups of near duplicates by components: the same as by all pairs, without making them."""

import datetime as dt
import random
from itertools import combinations

import pytest
from conftest import SF
from verify import compare

from tidewater.operators import messages

SCHEMA = "id string, received_at_utc timestamp_ntz, text string"


def _plain(rows, threshold):
    """Group of each message by comparing all sets of tokens with each other."""
    sets = {}
    for i, at, text in rows:
        if text.split():
            sets.setdefault(frozenset(text.split()), []).append((at, i))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(sets, 2):
        if len(a & b) / len(a | b) >= threshold:
            root[find(a)] = find(b)
    groups = {}
    for s, members in sets.items():
        groups.setdefault(find(s), []).extend(members)
    numbered = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    return {i: n for n, g in enumerate(numbered, 1) for _, i in g}


def _rows(seed):
    """Random sets of many and few words, chains of changed copies, copies that differ in a number, and short ones."""
    draw, texts = random.Random(seed), []
    for _ in range(60):
        texts.append(" ".join(draw.sample([f"w{i}" for i in range(40)], draw.randint(1, 9))))
        words = [f"v{draw.randint(0, 200)}" for _ in range(draw.randint(2, 12))]
        for step in range(draw.randint(1, 6)):
            texts.append(" ".join(words))
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 30)}"
    texts += [f"pay to {n} now" for n in range(20)] + [f"only {n}" for n in range(20)] + ["a", "a b", "b", "a b c", "", "a b c d"] + [f"the same long phrase with {n} in it" for n in (1, 1, 2)]
    draw.shuffle(texts)
    return [(f"m{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randint(0, 50)), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("threshold", "common", "block"), [(0.6, 100, 500), (0.5, 3, 4), (0.35, 2, 500)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, threshold, common, block):
    made = messages.component_links
    monkeypatch.setattr(messages, "component_links", lambda sets, t: made(sets, t, common, block))
    rows = _rows(round(threshold * 100) + common)
    got = {r["id"]: r["group_id"] for r in messages.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
    expected = _plain(rows, threshold)
    assert got == expected and len(set(expected.values())) > 10
    sizes = sorted(r["k"] for r in messages.near_duplicate_sizes(spark.createDataFrame(rows, SCHEMA), threshold).collect())
    assert sizes == sorted(list(expected.values()).count(g) for g in set(expected.values()))


def test_near_copies_make_no_pairs(spark, monkeypatch):
    """Links grow with the messages, not with the square of a group: copies with other numbers, and copies with a changed word each that others have too."""
    seen, made = [], messages.connected_components
    monkeypatch.setattr(messages, "connected_components", lambda edges: seen.append(edges.count()) or made(edges))
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join([*words, str(n)]) for n in range(600)] + [" ".join([*words[: n % 20], *words[n % 20 + 1 :], f"z{n // 40}", f"y{n % 40}"]) for n in range(600)]
    df = spark.createDataFrame([(f"m{i}", dt.datetime(2024, 1, 1), t) for i, t in enumerate(texts)], SCHEMA)
    got = messages.near_duplicate_groups(df).collect()
    assert len(got) == 1200 and {r["group_id"] for r in got} == {1}
    assert seen[0] < 20 * 1200


def test_no_messages_no_groups(spark):
    assert messages.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert messages.near_duplicate_groups(spark.createDataFrame([("a", dt.datetime(2024, 1, 1), "!"), ("b", dt.datetime(2024, 1, 1), "")], SCHEMA)).count() == 0


def test_totals_need_neither_pairs_nor_numbers(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    for name in ("near_duplicate_pairs", "near_duplicate_groups"):
        monkeypatch.setattr(messages, name, never)
    assert compare(spark, SF, "batch_totals") == "ok 18"
