import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from understory.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord("A") + i: ord("a") + i for i in range(26)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [" ".join(p) for p in zip(words, words[1:])]


def plain(docs, target, buckets=10000, percent=25, least=20, seed=7):
    """(id, n_features, weight, score, rank) of documents (id, text), feature by feature."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t)[1])
    t = Counter(place(f) for x in target for f in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((-r[3], -1 if r[0] is None else r[0]) for r in rows if r[4] >= least)
    rank = {x: i + 1 for i, x in reversed(list(enumerate(able[: percent * len(able) // 100])))}
    return [(*r[:4], rank.get((-r[3], -1 if r[0] is None else r[0])) if r[4] >= least else None) for r in rows]


def test_crc_matrices_are_the_library_crcs():
    rng = np.random.default_rng(1)
    strings = [rng.bytes(n) for n in rng.integers(0, 40, 2000)]
    flat = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    found = resampling.crc_matrices(flat, np.cumsum(lengths) - lengths, lengths)
    assert found.tolist() == [zlib.crc32(s) for s in strings]


@pytest.mark.parametrize("buckets", [10000, 1 << 20])
def test_buckets_of_texts(buckets):
    texts = ["The quick-brown fox ÀÉ 12", "", None, "one", "\x00a\x7fb", "x " * 500, "É é 中文 字"]
    n_words, n_features, found = resampling.buckets_of(texts, buckets)
    at = 0
    for text, w, n in zip(texts, n_words, n_features):
        words, all_ = features(text)
        assert (len(words), len(all_)) == (w, n)
        assert found[at : at + n].tolist() == [zlib.crc32(f.encode()) % buckets for f in all_]
        at += n


def test_equals_the_plain_version(spark, folder, documents):
    docs = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = resampling.resample(documents, benchmark)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(docs, [r[0] for r in benchmark.select("text").collect()]), key=str)


def test_missing_empty_long_and_repeated_rows(spark):
    text = "alpha beta gamma delta " * 6
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "--- !!"), (5, "word " * 50000), (None, text), (6, text + "zeta"), (7, "few words")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, rank int, k int")
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    found = resampling.resample(docs, target, percent=50).collect()
    expected = plain(rows, ["alpha beta", None], percent=50)
    strip = lambda r: tuple(r)[:4]
    assert sorted(map(strip, found), key=str) == sorted(map(strip, expected), key=str)
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == [1, 2]  # half of five able rows
    best = sorted((-r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in found if r["n_features"] > 30)
    assert [(-r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in drawn] == best[:2]
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        resampling.resample(docs.withColumnRenamed("doc_id", "score"), target, key="score")


def test_a_group_of_ties_is_ranked_without_gaps(spark):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "repeat('same words again ', 10) as text")
    found = resampling.resample(docs, docs)
    assert sorted(r[0] for r in found.where("rank is not null").select("rank").collect()) == list(range(1, 101))
