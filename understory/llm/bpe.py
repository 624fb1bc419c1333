"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

A word is a contiguous array of parts beside an array of the ranks of adjacent pairs.
The smallest rank is found by scanning, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank. Words are short, so a scan
costs less than a queue; words beyond ``SCAN_PARTS`` parts go through a queue that
gives the same parts. A task keeps words it has met, up to ``KEPT_WORDS``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

KEPT_WORDS = 200_000
SCAN_PARTS = 128
NO_RANK = 1 << 60

#: White space of the tokenizer's expressions.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens, pair ranks and word splitting of a tokenizer file's content."""

    def __init__(self, content: str):
        said = json.loads(content)
        model = said["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.first = [ids.get(c) for c in byte_letters()]
        self.last = [ids.get(c + self.suffix) for c in byte_letters()]
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of.setdefault(ids[a] << 24 | ids[b], rank)
            self.merged.append(ids[a + b])
        self.specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def parts(self, word: str) -> list[int]:
        """Token ids of one word, whole or in parts."""
        data = word.encode()
        found = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        found = [p for p in found if p is not None]
        return self._scan(found) if len(found) <= SCAN_PARTS else self._queue(found)

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.rank_of.get, self.merged
        ranks = [rank_of(a << 24 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 24 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 24 | parts[i + 1], NO_RANK)
        return parts

    def _queue(self, parts: list[int]) -> list[int]:
        """The same for a long word: ranks in a heap, parts in a linked list."""
        n, rank_of = len(parts), self.rank_of.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of(a << 24 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := rank_of(parts[x] << 24 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]


class Words(dict):
    """Token ids of words met so far, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        found = np.asarray(self.vocabulary.parts(word), "<u4").tobytes()
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()


_space = re.compile(f"[{SPACE}]+")
_numerals = regex.compile(r"[\p{Nl}\p{No}]")
# Letters and digits as the quick module knows them; texts with other numerals take the exact classes.
_quick = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w ]+|_+)+")
_exact = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")


def normal(text: str) -> str:
    """Composed form, white space to single blanks, lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return _space.sub(" ", text).lower()


def split_words(text: str) -> list[str]:
    """Words of a normalised text: contractions, runs of letters, single digits, runs of signs."""
    if text.isascii() or not _numerals.search(text):
        return _quick.findall(text)
    return _exact.findall(text)


def encode_text(text: str, words: Words) -> bytes:
    """Ids of one text. Special tokens in the raw text are themselves; all else is normalised and split."""
    vocabulary = words.vocabulary
    if vocabulary.special is None or not vocabulary.special.search(text):
        return b"".join(map(words.__getitem__, split_words(normal(text))))
    out = []
    for piece in vocabulary.special.split(text):
        if piece in vocabulary.specials:
            out.append(np.asarray([vocabulary.specials[piece]], "<u4").tobytes())
        else:
            out += map(words.__getitem__, split_words(normal(piece)))
    return b"".join(out)


_loaded: dict[str, Words] = {}


def words_of(key: str, content) -> Words:
    """The worker's word table of a vocabulary; ``content`` is a broadcast, read once per worker."""
    if key not in _loaded:
        _loaded[key] = Words(Vocabulary(content.value))
    return _loaded[key]


def load(spark: SparkSession, path: str) -> tuple[str, object]:
    """Key and broadcast of a tokenizer file that the driver reads; workers need no copy of it."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return hashlib.md5(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)


def _encode(texts: pa.Array, words: Words) -> pa.ListArray:
    ends, found = [0], []
    for text in texts:
        words.trim()
        found.append(encode_text(text.as_py() or "", words))
        ends.append(ends[-1] + len(found[-1]) // 4)
    ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _decode(ids: pa.ListArray, tokens: dict[int, str]) -> pa.StringArray:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    rows = (flat[a:b].tolist() if x.is_valid else [] for a, b, x in zip(ends, ends[1:], ids))
    return pa.array([" ".join([tokens[i] for i in row if i in tokens]) for row in rows], pa.string())


def encoder(spark: SparkSession, path: str):
    """Function of a text column that gives its token ids. Null text has none."""
    key, content = load(spark, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return _encode(texts, words_of(key, content))

    return encode


def decoder(spark: SparkSession, path: str):
    """Function of an ids column that gives the tokens, joined by blanks as the file names no decoder.

    Null ids give empty text; ids that no token has are left out.
    """
    key, content = load(spark, path)

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return _decode(ids, words_of(key, content).vocabulary.tokens)

    return decode


def coder(spark: SparkSession, path: str):
    """Function of a text column that gives ``ids``, the same as little-endian unsigned 32-bit
    integers in ``packed``, and what they decode to, ``decoded``: one pass through one worker."""
    key, content = load(spark, path)
    kinds = (("ids", T.ArrayType(T.IntegerType())), ("packed", T.BinaryType()), ("decoded", T.StringType()))

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in kinds]))
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = words_of(key, content)
        for texts in batches:
            ids = _encode(texts, words)
            ends = pa.array(ids.offsets.to_numpy() * 4, pa.int32())
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, ends.buffers()[1], ids.values.buffers()[1]])
            yield pa.StructArray.from_arrays([ids, packed, _decode(ids, words.vocabulary.tokens)], [n for n, _ in kinds])
        words.clear()  # an idle worker holds nothing but the vocabulary

    return code


def tokenize(docs: DataFrame, path: str, text: str = "text", out: tuple[str, str, str] = ("ids", "packed", "decoded")) -> DataFrame:
    """``docs`` with the token ids of each whole text, the same packed in bytes, and the text that they decode to.

    Nothing is shuffled. Null and empty texts have no ids and decode to empty text;
    repeated rows get equal results; an empty table stays empty. Columns of ``docs``
    named as the outputs are replaced, other columns stay as they are.
    """
    if text in out or len(set(out)) < 3:
        raise ValueError("the outputs need three names other than the text's")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    coded = docs.select(row.alias("_row"), coder(docs.sparkSession, path)(F.col(f"`{text}`")).alias("_coded"))
    return coded.select("_row.*", *[F.col(f"_coded.{n}").alias(c) for n, c in zip(("ids", "packed", "decoded"), out)])


def n_tokens(ids: Column) -> Column:
    return F.size(ids).cast("long")
