"""Edit-aware counts against counting the whole text again."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from understory.llm import bpe, queries, token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = "aAbB'’_-.,!?#$  \t\n\r\x1c\x85\xa0é½²Ⅷ٣12一한̧🙂st "


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counts():
    with open(PATH, encoding="utf-8") as f:
        return C.Counts(bpe.Vocabulary(f.read()))


def changed(text, start, delete, insert):
    start = min(max(start, 0), len(text))
    return text[:start] + insert + text[start + min(max(delete, 0), len(text) - start) :]


@pytest.mark.parametrize("leaf,full", [(1, 4), (3, 8), (32, 256)])
def test_edits_equal_counting_again(counts, library, monkeypatch, leaf, full):
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "FULL", full)
    draw = random.Random(leaf)
    mixed = lambda n: "".join(draw.choice(POOL) for _ in range(n))
    for _ in range(300):
        text = mixed(draw.randint(0, 200))
        tree = C.Tree(text, *map(C.sums_of, C.leaves_of(text, counts)), counts)
        for _ in range(draw.randint(1, 6)):
            edit = draw.randint(-2, len(text) + 3), draw.choice([0, 0, 1, 2, 5, 40, 400]), draw.choice(["", "x", " ", "  ", "\n", "'s", mixed(5), mixed(300)])
            text = changed(text, *edit)
            tree.edit(*edit)
            assert tree.text == text and tree.tokens[1] == library(text) and tree.chars[1] == len(text)


def test_an_edit_encodes_its_surroundings_only(counts):
    text = "The quick brown fox jumps over it. " * 20_000
    tree = C.Tree(text, *map(C.sums_of, C.leaves_of(text, counts)), counts)
    tree.edit(len(text) // 2, 5, "something else")
    assert tree.encoded < 4 * C.LEAF and tree.tokens[1] == sum(map(counts.__getitem__, C.split(changed(text, len(text) // 2, 5, "something else"))))


def test_query_equals_counting_again(spark, folder, documents, library):
    got = {r["doc_id"]: r for r in queries.op6_edited_token_counts(spark, folder).collect()}
    rows = documents.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    for doc_id, text, source in rows:
        new, size = text or "", len(text or "")
        for edit in ((0, 0, f"source: {source or ''}\n"), (size // 2, 24, "[masked]"), (size - 10, 12, "")):
            new = changed(new, *edit)
        r = got[doc_id]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (library(text or ""), library(new), len(new))


def test_edge_rows(spark, library):
    rows = [(1, None, [(0, 0, "in it")]), (2, "", []), (3, "some text", None), (3, "some text", None), (None, "some text", [(4, None, None), None, (None, 5, "other")]), (5, "x " * 100_000, [(10**12, 3, "end"), (-5, -5, "start")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, tree array<struct<start:long,delete:long,insert:string>>")
    out = C.follow(C.plant(df, PATH), PATH, F.col("_row.tree")).collect()
    new = {r["_row"]["doc_id"]: r["new_text"] for r in out}
    assert len(out) == 6 and new == {1: "in it", 2: "", 3: "some text", None: "othertext", 5: "start" + "x " * 100_000 + "end"}
    for r in out:
        assert r["new_tree"]["tokens"][1] == library(r["new_text"]) and r["tree"]["tokens"][1] == library(r["_row"]["text"] or "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.follow(C.plant(df, PATH), PATH, F.array()).collect() == []
