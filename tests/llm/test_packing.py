import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from understory.llm import byte_tokens, packing
from understory.llm.queries import op11_cost_balanced_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(sizes, capacity):
    """The method by looking at every piece and every sequence in each step."""
    room = packing.rooms(sum(sizes), capacity)
    free, spent = list(room), [packing.LINEAR * (capacity - r) for r in room]
    pieces = [(d, s, min(capacity, n - s)) for d, n in enumerate(sizes) for s in range(0, n, capacity)]
    out = []
    while pieces:
        d, start, n = piece = min(pieces, key=lambda p: (-p[2], p[0], p[1]))
        pieces.remove(piece)
        s = min((k for k in range(len(free)) if free[k]), key=lambda k: (spent[k], k))
        take = min(n, free[s])
        out.append((d, start, take, s, room[s] - free[s]))
        free[s] -= take
        spent[s] += packing.cost(take)
        if take < n:
            pieces.append((d, start + take, n - take))
    return sorted(out)


def test_the_heap_places_as_the_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, rng.choice([20, 300, 3000]), rng.integers(1, 30))
        assert list(map(tuple, packing.pack_bin(sizes).tolist())) == plain(sizes.tolist(), packing.CAPACITY)


def check(pieces, ids_of, capacity=packing.CAPACITY):
    """Every id once, sequences without gaps, none that must be padded."""
    documents, sequences = {}, {}
    for key, start, length, ids, doc_tokens, sequence, offset in pieces:
        ids = np.frombuffer(bytes(ids), "<u4").tolist()
        assert len(ids) == length > 0 and doc_tokens == len(ids_of[key])
        documents.setdefault(key, []).append((start, ids))
        sequences.setdefault(sequence, []).append((offset, length))
    for key, ids in ids_of.items():
        parts = sorted(documents[key])
        assert [s for s, _ in parts] == np.cumsum([0, *[len(x) for _, x in parts]])[:-1].tolist()
        assert [i for _, x in parts for i in x] == ids
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([0, *[n for _, n in parts]]).tolist()
        assert [o for o, _ in parts] == ends[:-1]
        assert ends[-1] == capacity or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < capacity


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_the_query_holds_every_id_of_the_library_once(spark, folder, documents):
    rows = documents.select("doc_id", "text").collect()
    ids = dict(zip([r[0] for r in rows], library([r[1] for r in rows])))
    found = op11_cost_balanced_packing(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    raw = packing.pack(documents, PATH).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").collect()
    check(raw, ids)
    digests = sorted((r[0], r[1], zlib.crc32(bytes(r[3]))) for r in raw)
    assert sorted((r[0], r[1], r[3]) for r in found.collect()) == digests


def test_costs_are_balanced(documents):
    full = packing.sequences(packing.pack(documents.coalesce(1), PATH)).where(f"tokens = {packing.CAPACITY}").toPandas()
    assert full["cost"].max() <= packing.cost(packing.CAPACITY)
    mixed = full[full["pieces"] > 1]["cost"]
    assert mixed.std() < 0.1 * mixed.mean()


def test_missing_empty_long_and_repeated_rows(spark):
    texts = [(1, None, 0), (2, "", 0), (3, "word " * 4000, 0), (4, "<|endoftext|>b", 0), (5, "a b", 0), (None, "x", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, start int")  # `start` clashes and plays no part
    found = packing.pack(docs, PATH, bin_tokens=64).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").collect()
    check(found, dict(zip([r[0] for r in texts], library([r[1] for r in texts]))))
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5")), PATH).collect()
    assert sum(r["length"] for r in twice) == 6
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, keep=("doc_id", "start"))


def test_any_capacity(documents):
    rows = documents.select("doc_id", "text").limit(20).collect()
    for capacity in (1, 7, 100):
        sizes = np.array([len(x) for x in library([r[1] for r in rows])])
        placed = packing.pack_bin(sizes, capacity)
        assert placed[:, 2].sum() == sizes.sum() and placed[:, 2].max() <= capacity


def test_encoder_gives_the_ids_of_the_library(documents, monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        own = byte_tokens.ByteTokens(f.read())
    rng = np.random.default_rng(5)
    letters = list("ab Z9\n\t'  é中ß🙂_-!½Ⅷ  \x1c̀") + ["<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + [r[0] or "" for r in documents.select("text").collect()]
    for piece in (byte_tokens.PIECE, 16):
        monkeypatch.setattr(byte_tokens, "PIECE", piece)
        for specials in (True, False):
            tokenizer.encode_special_tokens = not specials
            for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
                assert own.encode(text, specials).tolist() == e.ids
    blanks = " " * 1_500_000 + "x"
    assert own.encode(blanks, True).tolist() == tokenizer.encode(blanks, add_special_tokens=False).ids


def test_every_code_point_splits_as_in_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        own = byte_tokens.ByteTokens(f.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1 << 14):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)} " for c in points[k : k + (1 << 14)])
        assert own.encode(text, True).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
