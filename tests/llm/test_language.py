"""Partial matching: code lengths against a plain tree, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from understory.llm import language as L, queries


@pytest.fixture(scope="module")
def fitted(documents):
    sampled = L.sample(documents, 40)
    return L.build(*(np.array([r[c] for r in L.count_grams(sampled).collect()], t) for c, t in (("lang", object), ("gram", np.int64), ("length", np.int64), ("n", float)))), sampled.collect()


def test_code_lengths_equal_a_plain_tree(fitted, monkeypatch):
    model, rows = fitted
    trees = defaultdict(lambda: defaultdict(Counter))
    for r in rows:
        data = L.plain(r["text"])
        for i in range(len(data)):
            for k in range(min(L.ORDER, i) + 1):
                trees[r["lang"]][data[i - k : i]][data[i]] += 1

    def bits(tree, data):
        total = 0.0
        for i in range(len(data)):
            for k in range(min(L.ORDER, i), -1, -1):
                after = tree.get(data[i - k : i])
                if not after:
                    continue
                seen, kinds = sum(after.values()), len(after)
                if data[i] in after:
                    total += math.log2((seen + kinds) / after[data[i]])
                    break
                total += math.log2((seen + kinds) / kinds)
            else:
                total += 8
        return total

    texts = [L.plain(t) for t in ("the and of éçole ñ zzzqqq", rows[0]["text"][:500], "Ωμέγα und der", "q", "")]
    want = np.array([[bits(trees[name], t) for name in model.languages] for t in texts])
    assert np.allclose(model.code_lengths(texts), want, atol=1e-3)
    monkeypatch.setattr(L, "PIECE", 37)
    assert np.allclose(model.code_lengths(texts), want, atol=1e-3)


def test_held_out_accuracy(spark, folder, documents):
    got = {r["doc_id"]: r for r in queries.op9_ppm_language(spark, folder).collect()}
    rows = documents.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i, _ in rows)
    held = [(got[i]["lang_pred"], lang) for i, lang in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_edge_rows(spark, fitted):
    model, rows = fitted
    text = rows[0]["text"]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? ²", None), (None, text, "x"), (5, text * 3000, "y"), (5, text * 3000, "y")], "doc_id long, text string, score string")
    got = L.identify(df, model).collect()
    said = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert said[:3] == [(1, "und"), (2, "und"), (3, "und")] and {s for _, s in said[3:]} == {rows[0]["lang"]}
    assert all(r["score"] == 0 for r in got[:3]) and L.identify(df.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(None, "text"), ("en", None), ("en", "12")], "lang string, text string")
    for rows in (df, df.limit(0)):
        model = L.fit(rows)
        assert [r["lang_pred"] for r in L.identify(df, model).collect()] == ["und"] * 3


def test_no_gram_of_a_language_with_few_texts_is_cut(spark):
    draw = random.Random(4)
    many = [(f"l{k}", "".join(chr(draw.randrange(0x4E00 + 1500 * k, 0x4E00 + 1500 * (k + 1))) for _ in range(100_000))) for k in range(4)]
    few = "".join(map(chr, range(0x0561, 0x0587)))
    rows = spark.createDataFrame([(name, text + end) for name, text in many for end in ("", "x")] + [("few", few)], "lang string, text string")
    counted = L.count_grams(rows)
    assert counted.count() > 400_000
    model = L.fit(rows, per_language=10)
    assert len(model.cost[L.ORDER]) - 1 == counted.where(f"length = {L.ORDER + 1}").select("gram").distinct().count()
    texts = spark.createDataFrame([("few", few[3:20]), *((name, text[100:120]) for name, text in many)], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] for r in L.identify(texts, model).collect())


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string")
    assert {(r["lang_pred"], r["score"]) for r in L.identify(df, L.fit(df)).collect()} == {("a", 0.5)}
