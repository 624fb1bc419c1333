"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens. A leaf holds up to ``LEAF`` of
them in a row: how many code points and how many tokens; an inner node holds the sums
of its two children. An edit finds its leaves by code points, splits and encodes their
text again from two code points before the edit on, as a pre-token may look that far
ahead, and goes on until a pre-token ends where an old leaf ends; what follows is
unchanged. Only the sums above those leaves are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from understory.llm import bpe

#: Pre-tokens in a leaf when it is made; a tree whose leaf has grown to ``FULL`` is made anew.
LEAF, FULL = 32, 256
#: Code points before an edit, and after a leaf, that decide how the text splits.
CONTEXT = 2

_S = bpe.SPACE
# Fixed value: the pattern of the byte-level vocabularies. Texts with numerals that the quick module takes for letters get the exact classes.
_exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_quick = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_S}]|_)+|[{_S}]+(?![^{_S}])|[{_S}]+")


def split(text: str) -> list[str]:
    """Pre-tokens; together they are the text."""
    return (_quick if text.isascii() or not bpe._numerals.search(text) else _exact).findall(text)


class Counts(dict):
    """Number of tokens of pre-tokens met so far."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.vocabulary.parts(word))
        return n

    def trim(self) -> None:
        if len(self) > bpe.KEPT_WORDS:
            self.clear()


def leaves_of(text: str, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Code points and tokens of each leaf of a text."""
    words = split(text)
    starts = np.arange(0, len(words), LEAF)
    sums = lambda f: np.add.reduceat(np.fromiter(map(f, words), np.int64, len(words)), starts) if words else np.zeros(0, np.int64)
    return sums(len), sums(counts.__getitem__)


def sums_of(leaves: np.ndarray) -> np.ndarray:
    """The whole tree in an array: node i has the children 2i and 2i+1, leaves fill the second half."""
    width = 1 << max(len(leaves) - 1, 0).bit_length()
    levels = [np.concatenate([leaves, np.zeros(width - len(leaves), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    return np.concatenate([np.zeros(1, np.int64), *levels[::-1]])


class Tree:
    """A document's text in leaves with the sums above them."""

    def __init__(self, text: str, chars: Iterable[int], tokens: Iterable[int], counts: Counts):
        self.chars, self.tokens, self.counts = [int(x) for x in chars], [int(x) for x in tokens], counts
        self.width, self.encoded = len(self.chars) // 2, 0
        ends = np.cumsum([0, *self.chars[self.width :]]).tolist()
        self.texts = [text[a:b] for a, b in zip(ends, ends[1:])]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds code point ``at``, and where the leaf starts; the last one beyond the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.width
        self.chars[node], self.tokens[node] = len(text), tokens
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def _ahead(self, leaf: int) -> str:
        """The first code points behind a leaf."""
        found = ""
        while len(found) < CONTEXT and leaf + 1 < self.width:
            leaf += 1
            found += self.texts[leaf][: CONTEXT - len(found)]
        return found

    def edit(self, start: int, delete: int, insert: str) -> None:
        """Deletes ``delete`` code points from ``start`` on and puts ``insert`` there. Both numbers are held to the text."""
        size = self.chars[1] if self.width else 0
        start = min(max(start, 0), size)
        delete = min(max(delete, 0), size - start)
        first, at = self._find(max(start - CONTEXT, 0))
        last, _ = self._find(start + delete)
        old = "".join(self.texts[first : last + 1])
        region = old[: start - at] + insert + old[start - at + delete :]
        while True:
            # The code points ahead belong to the next leaf; they only show where the last pre-token ends.
            words, end = split(region + self._ahead(last)), 0
            own = []
            for word in words:
                if end >= len(region):
                    break
                own.append(word)
                end += len(word)
            if end == len(region):
                break
            last += 1
            region += self.texts[last]
        self.encoded += len(own)
        slots = last - first + 1
        each = -(-len(own) // slots)
        for k in range(slots):
            part = own[k * each : (k + 1) * each]
            self._put(first + k, "".join(part), sum(map(self.counts.__getitem__, part)))
        if each > FULL:
            text = self.text
            self.chars, self.tokens = (sums_of(x).tolist() for x in leaves_of(text, self.counts))
            self.__init__(text, self.chars, self.tokens, self.counts)


_loaded: dict[str, Counts] = {}


def _counts(key: str, content) -> Counts:
    if key not in _loaded:
        _loaded[key] = Counts(bpe.Vocabulary(content.value))
    _loaded[key].trim()
    return _loaded[key]


TREE = T.StructType().add("chars", T.ArrayType(T.LongType())).add("tokens", T.ArrayType(T.LongType()))
EDITED = T.StructType().add("text", T.StringType()).add("tree", TREE).add("n_encoded", T.LongType())
EDITS = "array<struct<start:bigint,delete:bigint,insert:string>>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _trees(chars: list, tokens: list) -> pa.StructArray:
    return pa.StructArray.from_arrays([_lists(chars), _lists(tokens)], ["chars", "tokens"])


def grower(spark: SparkSession, path: str):
    """Function of a text column that gives its tree."""
    key, content = bpe.load(spark, path)

    @F.arrow_udf(TREE)
    def grow(texts: pa.Array) -> pa.Array:
        chars, tokens = [], []
        for text in texts:
            a, b = leaves_of(text.as_py() or "", _counts(key, content))
            chars.append(sums_of(a))
            tokens.append(sums_of(b))
        return _trees(chars, tokens)

    return grow


def editor(spark: SparkSession, path: str):
    """Function of text, tree and edits that gives the new text, its tree and how many pre-tokens were encoded for it."""
    key, content = bpe.load(spark, path)

    @F.arrow_udf(EDITED)
    def change(texts: pa.Array, chars: pa.Array, tokens: pa.Array, edits: pa.Array) -> pa.Array:
        out, new_chars, new_tokens, encoded = [], [], [], []
        columns = [(a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()) for a in (chars, tokens)]
        for i, (text, changes) in enumerate(zip(texts, edits)):
            nodes = [flat[ends[i] : ends[i + 1]] for flat, ends in columns]
            tree = Tree(text.as_py() or "", *nodes, _counts(key, content))
            for e in changes.as_py() or []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
            out.append(tree.text)
            new_chars.append(np.asarray(tree.chars, np.int64))
            new_tokens.append(np.asarray(tree.tokens, np.int64))
            encoded.append(tree.encoded)
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), _trees(new_chars, new_tokens), pa.array(encoded, pa.int64())], ["text", "tree", "n_encoded"]
        )

    return change


def total(tree: Column) -> Column:
    """Tokens of the whole document: the tree's root."""
    return F.get(tree["tokens"], F.lit(1))


def plant(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``_row`` (the row as it came) and ``tree``. A null or empty text has a tree of one empty leaf and no tokens."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), grower(docs.sparkSession, path)(F.col(f"`{text}`")).alias("tree"))


def follow(trees: DataFrame, path: str, edits: Column, text: str = "text") -> DataFrame:
    """Applies ``edits`` (an array of ``start``, ``delete``, ``insert``, one after the other on the text that the
    ones before left) to rows of ``plant``.

    Gives ``_row``, ``tree`` as before, ``new_text``, ``new_tree`` and ``n_encoded``, the
    pre-tokens that were encoded again. Nothing is shuffled; the edits of a document
    come with its row, since each counts from the text that the last one left. Null
    edits change nothing, null numbers are 0, a null insert is empty, and numbers
    beyond the text are held to it. A null text is edited as an empty one. Repeated
    rows are edited each. Empty tables give no rows.
    """
    change = editor(trees.sparkSession, path)
    new = change(F.col(f"_row.`{text}`"), F.col("tree.chars"), F.col("tree.tokens"), edits.cast(EDITS))
    found = trees.select("_row", "tree", new.alias("_new"))
    return found.select("_row", "tree", F.col("_new.text").alias("new_text"), F.col("_new.tree").alias("new_tree"), F.col("_new.n_encoded").alias("n_encoded"))
