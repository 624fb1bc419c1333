"""Benchmark decontamination by pigeonhole edit matching.

A test item of m letters (words in lower case, one blank between) may differ from a
passage by k = floor(rate x m) edits. Cut into k+1 pieces, at least one piece of it
stands in the passage unchanged. One pass over a text finds all pieces of all items;
around every hit, Myers' bit-parallel distance decides.

Items travel to the tasks in blocks of bounded size, one pass over the documents
each; documents are never shuffled and no task holds more than a batch of them.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from understory.llm.common import aside

#: Edits allowed for each letter of an item.
RATE = 0.10
#: Bytes of item text in a block; the search tree takes some sixty times as much.
BLOCK_BYTES = 2 << 20
#: Letters of the grams that rule out most chance hits before distances are computed.
GRAM = 5

_word = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(_word.findall(text)).lower()


def distance(masks: dict[str, int], m: int, text: str, free_start: bool = True) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` letters to a part of ``text``, and the first end of such a part.

    ``masks`` has the pattern's positions of each letter as bits. The part may start
    anywhere, or only at the start of ``text`` without ``free_start``.
    """
    full, top, carry = (1 << m) - 1, 1 << (m - 1), 0 if free_start else 1
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        x = masks.get(c, 0) | minus
        d = ((plus + (x & plus)) ^ plus) | x
        up, down = minus | (full & ~(plus | d)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        x = (up << 1 | carry) & full
        plus, minus = (down << 1 & full) | (full & ~(x | d)), x & d
        if score < best:
            best, end = score, j
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def grams(text: str) -> list[str]:
    """Disjoint parts of ``GRAM`` letters."""
    return [text[i : i + GRAM] for i in range(0, len(text) - GRAM + 1, GRAM)]


class Matcher:
    """Items, their pieces in one search tree, and what verification needs."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in ((i, normal(t or "")) for i, t in items) if t]
        self.masks: dict[int, tuple[dict, dict, list]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            cuts = [j * len(t) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places[t[a:b]].append((n, a))
        self.tree = ahocorasick.Automaton()
        for piece, at in places.items():
            self.tree.add_word(piece, (len(piece), at))
        if places:
            self.tree.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item, the merged parts of ``text`` that hold every passage around a hit."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for end, (length, at) in self.tree.iter(text):
            for n, offset in at:
                _, t, k = self.items[n]
                a = end + 1 - length - offset - k
                b = a + len(t) + 2 * k
                spans = found[n]
                if spans and a <= spans[-1][1] and b >= spans[-1][0]:
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
                else:
                    spans.append([a, b])
        return found

    def find(self, text: str) -> list[tuple]:
        """``(item id, edits, start, end)`` of the closest passage for every item that ``text`` holds.

        Start and end count code points of ``text`` as it came.
        """
        if not self.items:
            return []
        plain, out, places = normal(text), [], None
        for n, spans in sorted(self.windows(plain).items()):
            name, t, k = self.items[n]
            best = None
            for a, b in spans:
                part = plain[max(a, 0) : b]
                at = part.find(t)
                if at >= 0:
                    hit = (0, max(a, 0) + at, max(a, 0) + at + len(t))
                elif k:
                    hit = self._verify(n, part, max(a, 0), k)
                else:
                    hit = None
                if hit and k == 0 and (plain[hit[1] - 1 : hit[1]].strip() or plain[hit[2] : hit[2] + 1].strip()):
                    hit = None
                if hit and (best is None or hit < best):
                    best = hit
            if best:
                places = places or self._places(text)
                out.append((name, best[0], places[best[1]][0], places[max(best[2] - 1, best[1])][1]))
        return out

    def _verify(self, n: int, part: str, start: int, k: int) -> tuple[int, int, int] | None:
        if n not in self.masks:
            t = self.items[n][1]
            self.masks[n] = masks_of(t), masks_of(t[::-1]), grams(t)
        forward, backward, own = self.masks[n]
        # An edit spoils at most one of the item's disjoint grams, so a passage within the budget has all others.
        if sum([g in part for g in own]) < len(own) - k:
            return None
        m = len(self.items[n][1])
        edits, end = distance(forward, m, part)
        if edits > k:
            return None
        _, back = distance(backward, m, part[:end][::-1][: m + k], free_start=False)
        return edits, start + end - back, start + end

    @staticmethod
    def _places(text: str) -> list[tuple[int, int]]:
        """Start and end in ``text`` of every letter of its normal form."""
        out: list[tuple[int, int]] = []
        for word in _word.finditer(text):
            if out:
                out.append((out[-1][1], word.start()))
            size = len(word.group().lower())
            last = word.end() - word.start() - 1
            out += [(word.start() + min(i, last), word.start() + min(i, last) + 1) for i in range(size)]
        return out + [(len(text), len(text))]


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, content) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(*content.value)
    return _matchers[key]


def blocks(benchmark: DataFrame, item_id: str, text: str):
    """Lists of ``(item id, text)``, each of about ``BLOCK_BYTES`` of text, one at a time on the driver."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    size = items.select(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _finder(docs: DataFrame, items: list[tuple], rate: float, kind: T.DataType):
    """Function of a text column that gives all matches with a block of items."""
    key, content = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, rate))
    row = T.StructType().add("item_id", kind).add("edits", T.LongType()).add("start", T.LongType()).add("end", T.LongType())
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(T.ArrayType(row))
    def matches(texts: pa.Array) -> pa.Array:
        matcher = _matcher(key, content)
        found = (matcher.find(t.as_py() or "") for t in texts)
        return pa.array([[dict(zip(("item_id", "edits", "start", "end"), x)) for x in f] for f in found], arrow)

    # Else Spark may move a filter on the matches below joins, where it can't run Python, or run it twice.
    return matches.asNondeterministic()


def leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``edits``, ``start``, ``end``.

    ``start`` and ``end`` are the closest passage's code points in the whole text, the
    earlier one of equals. Null and empty texts hold nothing, null and empty items are
    nowhere; items so short that no edit is allowed must stand as whole words. Repeated
    rows and items are reported each. Empty tables give no rows. Other columns are
    not read.
    """
    kind, found = benchmark.schema[item_id].dataType, None
    for items in blocks(benchmark, item_id, item_text):
        hits = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _finder(docs, items, rate, kind)(F.col(f"`{text}`")).alias("m"))
        part = hits.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = T.StructType().add("doc_id", docs.schema[doc_id].dataType).add("item_id", kind)
        for c in ("edits", "start", "end"):
            empty = empty.add(c, T.LongType())
        found = docs.sparkSession.createDataFrame([], empty)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, in their own columns. Nothing is shuffled."""
    kind, kept = benchmark.schema[item_id].dataType, docs
    for items in blocks(benchmark, item_id, item_text):
        held = aside(kept, _matches=_finder(docs, items, rate, kind)(F.col(f"`{text}`")))
        kept = held.where(F.size("_matches") == 0).select("_row.*")
    return kept
