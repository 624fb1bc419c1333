"""BPE against the tokenizers library, and its own edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from understory.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = "aAbBeEsStT'’_-.,!?#$ \t\n\r\x0b\x1c\x85\xa0​éÉßẞΣσςİı½²Ⅷ٣1一か한̧🙂<|>ﬁ"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def words():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Words(bpe.Vocabulary(f.read()))


def ids_of(text, words):
    return np.frombuffer(bpe.encode_text(text, words), "<u4").tolist()


def test_texts_as_the_library(library, words):
    draw = random.Random(3)
    special = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "'s", "'RE", "ΣΑΣ", "a" * 300, "!" * 200]
    for _ in range(3000):
        text = "".join(draw.choice(POOL) if draw.random() < 0.9 else draw.choice(special) for _ in range(draw.randint(0, 40)))
        assert ids_of(text, words) == library.encode(text, add_special_tokens=False).ids, text


def test_long_words_by_queue_equal_scan(words):
    draw = random.Random(4)
    for size in (2, 10, 100, 400):
        word = "".join(draw.choice("abcdeth") for _ in range(size))
        data = word.encode()
        parts = lambda: [words.vocabulary.first[b] for b in data[:-1]] + [words.vocabulary.last[data[-1]]]
        assert words.vocabulary._scan(parts()) == words.vocabulary._queue(parts())


def test_kept_words_are_bounded(words, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for text in ("one two three four", "five"):
        words.trim()
        ids_of(text, words)
    assert len(words) <= 5


def test_query_as_the_library(spark, folder, documents, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op1_bpe_round_trip(spark, folder).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id] == (len(ids), digest, hashlib.sha256(said.encode()).hexdigest())


def test_edge_rows(spark, library):
    long = "word " * 50_000
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Hello, world", None), (4, long, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `ids` string").withColumnRenamed("ids", "decoded")
    got = bpe.tokenize(df, PATH).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "text", "ids", "packed", "decoded"}
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["packed"]) == np.array(ids, "<u4").tobytes()
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_empty_table_and_decoding_alone(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, _row string")
    assert bpe.tokenize(empty, PATH).collect() == []
    ids = spark.createDataFrame([([320, 10_000_000],), (None,)], "ids array<int>")
    assert [r[0] for r in ids.select(bpe.decoder(spark, PATH)("ids")).collect()] == ["a</w>", ""]
