"""The similarity join against all pairs, and its edge cases."""

import random
import re

import numpy as np
import pytest

from understory.llm import common
from understory.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, threshold=0.8):
    """(id, class, copies, links) by comparing all pairs."""

    def grams(t):
        ws = WORD.findall((t or "").lower())
        return frozenset(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))) if ws else frozenset()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = [0] * len(rows), [1] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
            if a and a == b:
                copies[i] += 1
                copies[j] += 1
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted(((name, least.get(find(i)), copies[i], links[i]) for i, (name, _) in enumerate(rows)), key=str)


def joined(df, **more):
    return sorted((tuple(r) for r in J.join(df, **more).collect()), key=str)


def near(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"n{draw.random()}"
    return " ".join(words)


def corpus(groups=12, size=6, length=120, seed=1):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"g{g}w{draw.randrange(400)}" for _ in range(length)]
        rows += [(len(rows) + k, near(draw, words, draw.randrange(5))) for k in range(size)]
    return rows


def test_documents_as_all_pairs(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert joined(documents) == plain(rows)


def test_near_copies_around_the_threshold(spark):
    rows = corpus()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_large_buckets_are_split_and_blocked(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 5)
    rows = corpus(3, 30, seed=2) + [(1000 + k, "a copy that is everywhere in this table") for k in range(40)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_other_thresholds(spark):
    rows = corpus(8, 5, seed=3)
    for threshold in (0.5, 0.9):
        assert joined(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold) == plain(rows, threshold)


def test_edge_rows(spark):
    draw = random.Random(5)
    long = [f"w{draw.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "two words"), (5, "Two  WORDS"), (6, "one"), (6, "one"), (None, "one"), (None, None), (None, "alone with a null id"), (10, " ".join(long)), (9, near(draw, long, 50)), (2, "")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, class_id int, _set string")
    assert joined(df) == plain(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 2, 3, 4, 6, None, None, 9], key=str)


def test_components_with_and_without_hubs(spark, monkeypatch):
    draw = random.Random(9)
    edges = [(f"h{k % 3}", f"m{k}") for k in range(300)] + [(f"x{draw.randrange(80)}", f"x{draw.randrange(80)}") for _ in range(60)] + [("h0", "h1")]
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    want = sorted((n, top(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    table = spark.createDataFrame(edges, "a string, b string")
    for limit in (5, common.HUB_EDGES):
        monkeypatch.setattr(common, "HUB_EDGES", limit)
        assert sorted(map(tuple, common.components(table).collect())) == want


def test_one_row_of_every_class_stays(spark):
    same = "one and the same text that all have here"
    rows = [(1, same, 0), (1, same, 1), (2, same, 2), (None, same, 3), (None, same, 3), (None, "a text that only rows without an id have", 4), (None, "a text that only rows without an id have", 4)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, same), (None, rows[-1][1])], key=str)


def test_a_table_read_twice_loses_its_copies(documents):
    once = sorted(r[0] for r in J.keep_one(documents).where("trim(text) <> ''").select("doc_id").collect())
    twice = J.keep_one(documents.unionByName(documents))
    assert sorted(r[0] for r in twice.where("trim(text) <> ''").select("doc_id").collect()) == once


def test_runs_reach_the_recall():
    assert J.runs_needed(0.8, 0.9) < J.runs_needed(0.8, 0.9999) < J.runs_needed(0.5, 0.9999) < 60


def test_runs_and_floor_on_one_sketch_lose_no_more_than_stated():
    draw = np.random.default_rng(5)
    runs, floor = J.runs_needed(0.8, 0.9999), J.floor_needed(0.8, 0.9999)
    equal, n = draw.binomial(J.POSITIONS, 0.8, 4_000_000), 4_000_000
    # A last bucket is shared if a path of positions, one or (in a quarter of cases) two at each step, is equal all along.
    chance = np.ones(J.POSITIONS + 1)
    q = np.arange(J.POSITIONS + 1) / J.POSITIONS
    for _ in range(J.DEPTH):
        chance = 0.75 * q * chance + 0.25 * (1 - (1 - q * chance) ** 2)
    missed = (equal < floor) | (draw.random(n) < (1 - chance[equal]) ** runs)
    assert missed.mean() < 1.15e-4


def test_empty_table_and_bad_threshold(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert joined(empty) == [] and J.keep_one(empty).collect() == []
    with pytest.raises(ValueError):
        J.join(empty, threshold=1.0)
