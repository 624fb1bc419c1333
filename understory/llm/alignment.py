"""Alignment of two tokenizers' tokens of one text, and corpus-wide counts of aligned ids.

Tokens of both sides tile the same bytes. An interval of both token sequences is divided
at a common end near its middle, found by bisecting the other side's ends, and both
halves are divided in turn; an interval without a common end inside is a leaf group. All
intervals of a batch of texts are divided together, level by level: first the ends in
their middles are looked up, then ends around these in windows that double.

Two tokens are linked if their bytes overlap. How many documents hold a pair of ids
linked is counted over all documents. The most frequent pairs, a bounded number, are
looked up in the tasks; the others are joined, each on few rows by that bound.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from understory.llm import byte_tokens
from understory.llm.bpe import SPACE
from understory.session import pin, scratch_path

#: Pairs of ids that are looked up in the tasks, at most.
LOOKED_UP = 1 << 19
#: Code points that the piece model is given at a time, as far as a blank ends them.
PIECE = 1 << 16
#: Fixed value: the letter that stands for a blank in pieces.
BLANK = "▁"

_byte = re.compile(r"<0x([0-9A-F]{2})>")
_cut = re.compile(rf"(?<=[^{SPACE}{BLANK}]) ")

ALIGNED = (
    ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()),
    ("groups", T.StringType()), ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())),
)


class Pieces:
    """Encoder, and the bytes of every id, of a sentencepiece model that puts a blank before a text."""

    def __init__(self, model: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.coder.vocab_size()
        names = [self.coder.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _byte.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in names]
        # Blanks lead pieces only, so no piece crosses the start of a word and long texts may be cut there.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in names)

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE or not self.cuts:
            return self.coder.encode(text, num_threads=1)
        found, start = [], 0
        while start < len(text):
            end = _cut.search(text, start + PIECE)
            # The blank at the cut is the one that the model puts before the next part.
            found += self.coder.encode(text[start : end.start()] if end else text[start:], num_threads=1)
            start = end.end() if end else len(text)
        return found


_loaded: dict[str, Pieces] = {}


def load(spark: SparkSession, path: str):
    """Function without arguments that gives a worker its piece model; the driver reads the file."""
    with open(path, "rb") as f:
        content = f.read()
    key, shared = hashlib.md5(content).hexdigest(), spark.sparkContext.broadcast(content)

    def pieces() -> Pieces:
        if key not in _loaded:
            _loaded[key] = Pieces(shared.value)
        return _loaded[key]

    return pieces


def _ragged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the number of the range that each is from."""
    n = np.maximum(stop - start, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), of


def divide(ends_a: np.ndarray, ends_b: np.ndarray, whole_a: np.ndarray, whole_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides before the end of each leaf group, in order.

    ``ends_a`` and ``ends_b`` are the ends of all tokens, ascending over all texts;
    ``whole_a`` and ``whole_b`` are the numbers of tokens before the end of each text.
    """
    lo_a, hi_a = np.concatenate([[0], whole_a[:-1]]).astype(np.int64), whole_a.astype(np.int64)
    lo_b, hi_b = np.concatenate([[0], whole_b[:-1]]).astype(np.int64), whole_b.astype(np.int64)
    leaves_a, leaves_b = [], []

    def leaf(which):
        leaves_a.append(hi_a[which])
        leaves_b.append(hi_b[which])

    while len(lo_a):
        # An inner end needs two tokens on both sides.
        single = (hi_a - lo_a < 2) | (hi_b - lo_b < 2)
        leaf(single)
        lo_a, hi_a, lo_b, hi_b = (x[~single] for x in (lo_a, hi_a, lo_b, hi_b))
        middle = (lo_a + hi_a) // 2 - 1  # inner ends are those of the tokens lo_a to hi_a - 2
        at = np.searchsorted(ends_b, ends_a[middle])
        cut_a = np.where(ends_b[at] == ends_a[middle], middle, -1)
        cut_b = at
        open_, reach, width = np.flatnonzero(cut_a < 0), 0, 1
        while len(open_):
            # The next window on both sides of what has been looked at; the nearest common end counts.
            best = np.full(len(open_), np.iinfo(np.int64).max)
            mid = middle[open_]
            for first, last in ((np.maximum(mid - reach - width, lo_a[open_]), mid - reach), (mid + reach + 1, np.minimum(mid + reach + width, hi_a[open_] - 2) + 1)):
                probe, of = _ragged(first, last)
                found = np.searchsorted(ends_b, ends_a[probe])
                same = ends_b[found] == ends_a[probe]
                probe, of = probe[same], of[same]
                np.minimum.at(best, of, 2 * np.abs(probe - mid[of]) + (probe > mid[of]))
            hit = best < np.iinfo(np.int64).max
            chosen = mid[hit] + np.where(best[hit] & 1, best[hit] >> 1, -(best[hit] >> 1))
            cut_a[open_[hit]] = chosen
            cut_b[open_[hit]] = np.searchsorted(ends_b, ends_a[chosen])
            reach, width = reach + width, 2 * width
            open_, mid = open_[~hit], mid[~hit]
            more = (mid - reach > lo_a[open_]) | (mid + reach < hi_a[open_] - 2)
            open_ = open_[more]
        cutless = cut_a < 0
        leaf(cutless)
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = (x[~cutless] for x in (lo_a, hi_a, lo_b, hi_b, cut_a, cut_b))
        halves = lambda x, y: np.column_stack([x, y]).ravel()
        lo_a, hi_a, lo_b, hi_b = halves(lo_a, cut_a + 1), halves(cut_a + 1, hi_a), halves(lo_b, cut_b + 1), halves(cut_b + 1, hi_b)
    after_a, after_b = np.concatenate([[0], *leaves_a])[1:], np.concatenate([[0], *leaves_b])[1:]
    order = np.argsort(after_a)
    return after_a[order].astype(np.int64), after_b[order].astype(np.int64)


def _spelled(ids_a, ids_b, after_a, after_b, words) -> list[str]:
    """Every token's id with the sign behind it, in the order of the groups: A's ids, then B's."""
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[after_a - 1], last_b[after_b - 1] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + np.concatenate([[0], after_b])[group_a]] = 2 * ids_a + last_a
    out[np.arange(len(ids_b)) + after_a[group_b]] = words[1] + 2 * ids_b + last_b
    return list(map(words[0].__getitem__, out.tolist()))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Aligned tokens of every row: the columns in ``keep``, then

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``: tokens of both sides, leaf groups, and
    overlapping pairs of tokens; ``groups``: ids of each group, as in ``1,2|7;3|8,9``;
    ``pairs``, ``times``: distinct linked pairs of ids, coded by ``pair_code``, and how often the row holds them.

    Side A is the byte-level tokenizer file at ``path_a`` on a blank and the text, with
    strings of special tokens as plain text; side B the piece model at ``path_b`` on the
    text. Null and empty texts, and texts whose tokens don't spell a blank and the text,
    have zeros, empty ``groups`` and no pairs. Repeated rows get equal results, an empty table
    stays empty. Columns outside ``keep`` play no part; one in ``keep`` must not have a name of the outputs.
    """
    if set(keep) & {n for n, _ in ALIGNED}:
        raise ValueError("a kept column has the name of an output")
    tokens, pieces = byte_tokens.load(docs.sparkSession, path_a), load(docs.sparkSession, path_b)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t in ALIGNED])

    def run(batches):
        side_a, side_b = tokens(), pieces()
        bytes_a, bytes_b = (np.fromiter(map(len, s.bytes), np.int64, s.size) for s in (side_a, side_b))
        words = [f"{i}{sign}" for i in range(side_a.size) for sign in ",|"] + [f"{i}{sign}" for i in range(side_b.size) for sign in ",;"]
        for batch in batches:
            ids_a, ids_b = [], []
            for value in batch.column("text"):
                text = value.as_py()
                a, b = np.zeros(0, np.int64), []
                if text:
                    said = b" " + text.encode()
                    b = side_b.encode(text)
                    if b"".join(map(side_b.bytes.__getitem__, b)) == said:
                        a = side_a.encode(" " + text, specials=False).astype(np.int64)
                    if int(bytes_a[a].sum()) != len(said):
                        a, b = a[:0], []
                ids_a.append(a)
                ids_b.append(np.array(b, np.int64))
            columns = _align_batch(ids_a, ids_b, bytes_a, bytes_b, (words, 2 * side_a.size), side_b.size)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *columns], schema.names)

    return rows.mapInArrow(run, schema)


def _align_batch(ids_a, ids_b, bytes_a, bytes_b, words, size_b) -> list[pa.Array]:
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(bytes_a[ids_a]), np.cumsum(bytes_b[ids_b])
    full = n_a > 0
    whole_a, whole_b = np.cumsum(n_a), np.cumsum(n_b)
    after_a, after_b = divide(ends_a, ends_b, whole_a[full], whole_b[full])
    groups_before = np.searchsorted(after_a, whole_a, side="right")
    n_groups = np.diff(groups_before, prepend=0)
    # Where two cuts of the bytes meet, each end of either side closes one overlapping pair.
    inner = np.ones(len(ids_b), bool)
    inner[after_b - 1] = False
    other_b, other_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b[inner])
    code = np.concatenate([ids_a * size_b + ids_b[other_b], ids_a[other_a] * size_b + ids_b[inner]])
    row_a = np.repeat(np.arange(len(n_a)), n_a)
    row = np.concatenate([row_a, row_a[other_a]])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    times = np.diff(first, append=len(code))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n_a)))]).astype(np.int32))
    spelled = _spelled(ids_a, ids_b, after_a, after_b, words)
    stops = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(spelled[a:b])[:-1] for a, b in zip([0, *stops], stops)]
    return [
        pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(groups, pa.string()),
        pa.ListArray.from_arrays(ends, pa.array(code[first])), pa.ListArray.from_arrays(ends, pa.array(times)),
    ]


def pair_code(a: int, b: int, size_b: int) -> int:
    """The number that stands for a pair of ids where side B has ``size_b`` ids."""
    return a * size_b + b


def size_of(path: str) -> int:
    """Ids of a piece model."""
    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n``, ``best``: rows that hold each pair, and whether no pair of the same A id has more."""
    counts = pin(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a: Column = F.floor(F.col("pair") / F.lit(size_b)).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # as many rows as side A has ids
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(aligned: DataFrame, size_b: int, looked_up: int = LOOKED_UP) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of ``pairs`` and ``times``.

    A pair's count is the number of rows of ``aligned`` that hold it. ``count_sum`` adds up
    the counts of a row's links, ``n_best`` is how many of them have the highest count of
    their A id; rows without links have zeros. Other columns stay as they are.

    Aligned rows are written to the shared folder once. More than ``looked_up`` pairs
    can't be in more than one of ``looked_up`` rows each, counted over all pairs, so these
    are the ones that are looked up in the tasks, and the join deals with the rest.
    """
    spark = aligned.sparkSession
    path = scratch_path(spark, "aligned")
    row = F.struct(*[F.col(f"`{c}`") for c in aligned.columns if c not in ("pairs", "times")])
    aligned.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), "pairs", "times").write.parquet(path)
    table = spark.read.parquet(path)
    counts = pin(pair_counts(table, size_b))
    total = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n")).first()
    often = counts if total["pairs"] <= looked_up else counts.where(F.col("n") * looked_up > total["n"])
    known = often.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("pair", "n", "best")])
    rest = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([table.schema["id"], table.schema["row"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", rest)])

    def look_up(batches):
        pair, n, best = shared.value
        for batch in batches:
            held, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            codes, ends = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
            found = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            at = at[found]
            parts = []
            for values in (times[found] * best[at], times[found] * n[at]):
                whole = np.zeros(len(codes), np.int64)
                whole[found] = values
                sums = np.concatenate([[0], np.cumsum(whole)])
                parts.append(pa.array(sums[ends[1:]] - sums[ends[:-1]]))
            left = np.concatenate([[0], np.cumsum(~found)])[ends].astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(codes[~found]), pa.array(times[~found])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *parts, pa.ListArray.from_arrays(pa.array(left), items)], schema.names)

    looked = table.mapInArrow(look_up, schema)
    if len(known) == total["pairs"]:
        return looked.select("row.*", "n_best", "count_sum")
    second = scratch_path(spark, "looked-up")
    looked.write.parquet(second)
    looked = spark.read.parquet(second)
    few = looked.select("id", F.inline("rest")).join(counts, "pair").groupBy("id").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    both = looked.drop("rest").join(few, "id", "left")
    return both.select(
        "row.*", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
