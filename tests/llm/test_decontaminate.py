"""Edit matching against a plain distance table, and its edge cases."""

import random

from understory.llm import decontaminate as D

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew some potion in the old tower"


def table(pattern, text, free=True):
    row = [0] * (len(text) + 1) if free else list(range(len(text) + 1))
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distance_equals_the_table():
    draw = random.Random(0)
    for _ in range(1500):
        p = "".join(draw.choice("ab ") for _ in range(draw.randint(1, 80)))
        t = "".join(draw.choice("ab ") for _ in range(draw.randint(0, 100)))
        for free in (True, False):
            assert D.distance(D.masks_of(p), len(p), t, free)[0] == table(p, t, free)


def test_every_passage_within_the_budget_is_found():
    draw, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz "
    matcher = D.Matcher([(7, ITEM)], 0.10)
    budget = int(len(ITEM) * 0.10)
    for _ in range(300):
        passage = list(ITEM)
        for _ in range(draw.randint(0, budget + 6)):
            at = draw.randrange(len(passage))
            kind = draw.random()
            if kind < 0.34:
                passage[at] = draw.choice(letters)
            elif kind < 0.67:
                del passage[at]
            else:
                passage.insert(at, draw.choice(letters))
        noise = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(0, 200)))
        text = noise() + " " + "".join(passage) + " " + noise()
        best = table(ITEM, D.normal(text))
        found = matcher.find(text)
        assert (best <= budget) == bool(found)
        assert not found or found[0][:2] == (7, best)


def test_leaks_and_edges(spark):
    wordy = ITEM.upper().replace(" ", ",\n ")
    rows = [
        (1, f"Before. {wordy}! After.", "a"), (2, "Nothing of that kind here.", "b"), (3, None, None), (4, "", "c"),
        (None, f"x {ITEM} y", "d"), (6, "filler words " * 50_000 + ITEM, "e"), (6, "filler words " * 50_000 + ITEM, "e"), (8, "an answering machine: 42", "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, ITEM, 1), (5, ITEM, 1), (6, None, 2), (7, " .. ", 3), (None, "42", 4), (9, "answer", 5)], "item_id long, text string, doc_id int")
    got = D.leaks(docs, bench).collect()
    found = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got), key=str)
    assert found == sorted([(1, 5, 0)] * 2 + [(None, 5, 0)] * 2 + [(6, 5, 0)] * 4 + [(8, None, 0)], key=str)
    hit = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][hit["start"] : hit["end"]] == wordy
    kept = D.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_blocks_of_items_give_the_same(spark, folder, documents, monkeypatch):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(documents, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    assert len(list(D.blocks(bench, "item_id", "text"))) > 1
    assert sorted(map(tuple, D.leaks(documents, bench).collect())) == whole and whole


def test_all_exact_passages_of_the_tables_are_found(spark, folder, documents):
    bench = [(r["item_id"], D.normal(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in bench if t in D.normal(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(documents, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert want and want <= got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.leaks(docs.limit(0), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []
    assert D.without_leaks(docs, bench.limit(0)).count() == 1 and D.without_leaks(docs.limit(0), bench).count() == 0
