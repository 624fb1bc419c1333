import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from understory.llm import alignment
from understory.llm.bpe import byte_letters
from understory.llm.queries import op13_shared_cut_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(tokens):
    ends = list(itertools.accumulate(map(len, tokens)))
    return list(zip([0, *ends], ends))


class Plain:
    """Groups and links by comparing byte ranges."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = {c: i for i, c in enumerate(byte_letters())}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def of(self, text):
        said = b" " + (text or "").encode()
        if not text:
            return [], [], "", Counter(), 0
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        tokens_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in ids_a]
        tokens_b = [self.b_bytes(i) for i in ids_b]
        if b"".join(tokens_a) != said or b"".join(tokens_b) != said:
            return [], [], "", Counter(), 0
        spans_a, spans_b = spans(tokens_a), spans(tokens_b)
        cuts = {e for _, e in spans_a} & {e for _, e in spans_b}
        sides = []
        for ids, x in ((ids_a, spans_a), (ids_b, spans_b)):
            sides.append([[]])
            for i, (_, e) in zip(ids, x):
                sides[-1][-1].append(str(i))
                if e in cuts:
                    sides[-1].append([])
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)][:-1]
        links, j = Counter(), 0
        for i, (s, e) in zip(ids_a, spans_a):
            while spans_b[j][1] <= s:
                j += 1
            k = j
            while k < len(spans_b) and spans_b[k][0] < e:
                links[i, ids_b[k]] += 1
                k += 1
        return ids_a, ids_b, ";".join(groups), links, len(groups)

    def rows(self, docs):
        done = [(key, *self.of(text)) for key, text in docs]
        count = Counter(pair for row in done for pair in row[4])
        best = {}
        for (a, _), n in count.items():
            best[a] = max(best.get(a, 0), n)
        out = []
        for key, a, b, groups, links, n in done:
            out.append((
                key, len(a), len(b), n, links.total(), sum(t for p, t in links.items() if count[p] == best[p[0]]),
                sum(t * count[p] for p, t in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            ))
        return out


def test_the_query_equals_the_plain_version(spark, folder, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    docs = [(k, t) for k, t in docs if t is None or len(t) < 3000]
    few = spark.createDataFrame(docs, "doc_id long, text string")
    expected = sorted(Plain().rows(docs))
    for looked_up in (alignment.LOOKED_UP, 50, 1):  # the last two join most pairs
        found = alignment.align(few, A, B).selectExpr("doc_id", "n_a", "n_b", "n_groups", "n_links", "if(n_groups = 0, '', sha2(groups, 256)) as sha", "pairs", "times")
        done = alignment.weigh(found, alignment.size_of(B), looked_up)
        assert sorted(map(tuple, done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect())) == expected
    whole = op13_shared_cut_alignment(spark, folder)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    at = {k: r for k, *r in expected}
    for k, *r in whole.collect():
        if k in at:
            assert [*r[:4], r[6]] == [*at[k][:4], at[k][6]]


def test_division_finds_every_common_end_whatever_the_intervals():
    rng = np.random.default_rng(7)
    for _ in range(500):
        ends_a, ends_b, whole_a, whole_b, base = [], [], [], [], 0
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(1, 400))
            for ends, whole in ((ends_a, whole_a), (ends_b, whole_b)):
                inner = np.flatnonzero(rng.random(n - 1) < rng.random() ** 3) + 1
                ends += [*(base + inner).tolist(), base + n]
                whole.append(len(ends))
            base += n
        a, b = alignment.divide(*map(np.array, (ends_a, ends_b, whole_a, whole_b)))
        common = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[i - 1] for i in a] == common == [ends_b[i - 1] for i in b]


def test_a_long_interval_without_a_cut_is_one_group():
    odd, even = np.append(np.arange(1, 200_001, 2), 200_002), np.append(np.arange(2, 200_001, 2), 200_002)
    a, b = alignment.divide(odd, even, np.array([len(odd)]), np.array([len(even)]))
    assert a.tolist() == [len(odd)] and b.tolist() == [len(even)]


def test_missing_empty_long_and_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "▁ a real ▁"), (4, "same text <|endoftext|> </s> é🙂"), (4, "same text <|endoftext|> </s> é🙂"), (None, "  two  blanks\n\ttab\x00 "),
        (5, "word and wörd\n" * 10000), (6, "a" * 5000), (7, " "),
    ]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_a int")  # `n_a` clashes and plays no part
    aligned = alignment.align(docs, A, B)
    done = alignment.weigh(aligned, alignment.size_of(B)).collect()
    found = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in done]
    assert sorted(found, key=str) == sorted(Plain().rows(rows), key=str)
    assert alignment.weigh(alignment.align(docs.limit(0), A, B), 32000).count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs, A, B, keep=("doc_id", "n_a"))


def test_pieces_of_a_cut_text_are_those_of_the_whole(documents, monkeypatch):
    with open(B, "rb") as f:
        own = alignment.Pieces(f.read())
    texts = [r[0] or "" for r in documents.select("text").collect()] + ["a  b" * 50, " " * 300, "x \n " * 80, "▁ a ▁" * 50, "\t a" * 50]
    monkeypatch.setattr(alignment, "PIECE", 20)
    for text in texts:
        assert own.encode(text) == own.coder.encode(text)
