"""Similarity join on word shingles by chosen paths.

A text is the set of its ``SHINGLE``-word shingles; texts with equal sets are one
representative. Each run starts with all representatives in one bucket. A bucket
that is too large is split on shared tokens: the path to it draws one or two of the
positions of a min-hash sketch (1 / threshold of them in expectation), and members
whose token there is equal stay together. Buckets of one member end; small ones,
and those that still are large after the last split, are compared sketch by sketch,
the large ones block against block. Runs repeat until a pair at the threshold is
missed with a probability below ``1 - recall``.

What the sketches leave as candidates is verified on the whole sets: every connected
group of candidates is compared exactly, again in blocks. Tasks pass on numbers of
links and enough links to keep groups connected, never all pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from understory.llm.common import components, small_side
from understory.session import pin

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Positions of a sketch, splits of a bucket at most, and members up to which a bucket is small.
POSITIONS, DEPTH, SMALL = 64, 3, 256
#: Members and shingles of a block in exact comparison.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 4_000_000

_word = re.compile(r"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(20)
_turns = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_mixes = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words in lower case. A shorter text is one shingle; one without words has none."""
    words = _word.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 300_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - size + 1, 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = (out + h[k : k + n]) * _turns[k % SHINGLE]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """Min-hash of a set at every position."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 4096):
        x = found[a : a + 4096, None]
        low = np.minimum(low, ((x ^ (x >> np.uint64(32))) * _mixes).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def _equal(threshold: float) -> list[float]:
    """Probability that a pair at the threshold has 0, 1, ... equal positions."""
    return [math.comb(POSITIONS, k) * threshold**k * (1 - threshold) ** (POSITIONS - k) for k in range(POSITIONS + 1)]


def floor_needed(threshold: float, recall: float) -> int:
    """Equal positions that a candidate needs: at most a tenth of the loss is pairs at the threshold with fewer."""
    lost = list(itertools.accumulate(_equal(threshold)))
    return next(k for k, p in enumerate(lost) if p > (1 - recall) / 10)


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``recall``.

    All runs read one sketch: given its equal positions they are independent, over all pairs they aren't.
    """
    chances, floor, base, more = _equal(threshold), floor_needed(threshold, recall), int(1 / threshold), 1 / threshold % 1
    apart_once = []
    for k in range(floor, POSITIONS + 1):
        stay = 1.0
        for _ in range(depth):
            apart = 1 - k / POSITIONS * stay
            stay = 1 - apart**base * (1 - more + more * apart)
        apart_once.append(1 - stay)
    below, runs = sum(chances[:floor]), 1
    while below + sum(p * miss**runs for p, miss in zip(chances[floor:], apart_once)) > 1 - recall:
        runs += 1
    return runs


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id``, ``_text_id``, ``_set`` (digest of the shingle set, null without words), ``_n`` shingles, ``_sketch``."""
    kind = docs.schema[doc_id].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, sketches = [], [], []
            for t in batch.column("_text"):
                found = shingles(t.as_py())
                sizes.append(len(found))
                sets.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_text_id"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                ["_id", "_text_id", "_set", "_n", "_sketch"],
            )
        _hashes.clear()  # an idle worker holds none

    schema = T.StructType().add("_id", kind).add("_text_id", T.StringType()).add("_set", T.BinaryType()).add("_n", T.LongType()).add("_sketch", T.BinaryType())
    return _keyed(docs, doc_id, text).mapInArrow(work, schema)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), F.md5(body.cast("binary")).alias("_text_id"), body.alias("_text"))


def children(path: Column, sketched_at: Column, threshold: float) -> Column:
    """Paths of a member one split further down; the path alone draws the positions."""
    base, more = int(1 / threshold), 1 / threshold % 1
    at = lambda j: F.pmod(F.xxhash64(path, F.lit(j)), F.lit(POSITIONS)).cast("int")
    drawn = [at(j) for j in range(base)]
    luck = F.pmod(F.xxhash64(path, F.lit(-1)), F.lit(1 << 20)) < F.lit(int(more * (1 << 20)))
    positions = F.array_distinct(F.concat(F.array(*drawn), F.when(luck, F.array(at(base))).otherwise(F.array().cast("array<int>"))))
    return F.transform(positions, lambda i: F.xxhash64(path, i, F.substring(sketched_at, i * 4 + 1, F.lit(4))))


def buckets(members: DataFrame, threshold: float, runs: int) -> DataFrame:
    """``_path``, ``_set``, ``_size`` of all last buckets with two members or more. ``members`` has ``_set``, ``_sketch``.

    Rows on the way are a path and a digest; paths with one member end at once.
    """
    alive = members.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(r))).alias("_path"), "_set", "_sketch")
    done = None
    for level in range(1, DEPTH + 1):
        down = alive.select(F.explode(children(F.col("_path"), F.col("_sketch"), threshold)).alias("_path"), "_set")
        sizes = down.groupBy("_path").agg(F.count("*").alias("_size")).where("_size > 1")
        shared = pin(down.join(sizes, "_path"))
        ended = shared if level == DEPTH else shared.where(F.col("_size") <= SMALL)
        done = ended if done is None else done.unionByName(ended)
        if level < DEPTH:
            large = shared.where(F.col("_size") > SMALL).select("_path", "_set")
            if not large.take(1):
                break
            alive = large.join(members, "_set")
    return done


def blocked(rows: DataFrame, key: str, member: str, blocks: Column) -> DataFrame:
    """``rows`` once for every pair of blocks (``_bi`` <= ``_bj``) that a row's block is in; ``_in`` is its own block.

    ``blocks`` is the number of blocks of the row's group, of which a row is dealt to one.
    """
    own = rows.withColumn("_blocks", blocks).withColumn("_in", F.pmod(F.xxhash64(member, F.lit(3)), "_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    pairs = own.withColumn("_with", other)
    pairs = pairs.withColumn("_bi", F.least("_in", "_with")).withColumn("_bj", F.greatest("_in", "_with")).drop("_with", "_blocks")
    return pairs.repartition(key, "_bi", "_bj").sortWithinPartitions(key, "_bi", "_bj")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the groups of sorted batches; a group may reach over several batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        names = list(zip(*columns))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts, cuts[1:]):
            if held and names[a] != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
            last = names[a]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _labels(near: np.ndarray) -> np.ndarray:
    """Index of the first member of each member's connected component."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _across(table: pa.Table) -> np.ndarray:
    """Which pairs this pair of blocks is to compare: all within a block, or one block against the other."""
    own = table.column("_in").to_numpy()
    if table.column("_bi")[0].as_py() == table.column("_bj")[0].as_py():
        return ~np.eye(len(own), dtype=bool)
    return own[:, None] != own[None, :]


def _own(table: pa.Table) -> np.ndarray:
    """Which pairs of members are of one block."""
    own = table.column("_in").to_numpy()
    return (own[:, None] == own[None, :]) & ~np.eye(len(own), dtype=bool)


def _roots(near: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which members to link to which, so that all pairs of blocks together connect what ``near`` does.

    Within a block every member is linked to the first of its part. Two blocks link those firsts
    only, so a large group has about one link a member and a few for each pair of blocks. Members are
    in the order of their digests, so all tasks take the same firsts.
    """
    firsts, label = _labels(near & _own(table)), _labels(near)
    at = np.arange(len(near))
    if table.column("_bi")[0].as_py() == table.column("_bj")[0].as_py():
        return at[firsts != at], firsts[firsts != at]
    moved = (firsts == at) & (label != at)
    return at[moved], label[moved]


def candidates(members: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: for each bucket, links that keep members connected whose sketches agree at ``least`` of the positions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["_path", "_bi", "_bj"]):
            t = t.sort_by("_set")
            names = t.column("_set").to_pylist()
            marks = np.frombuffer(b"".join(t.column("_sketch").to_pylist()), "<u4").reshape(len(names), POSITIONS)
            same = np.stack([(marks == m).sum(1, dtype=np.int16) for m in marks])
            at, first = _roots((same >= least * POSITIONS) & ~np.eye(len(names), dtype=bool), t)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.binary()), pa.array([names[i] for i in first], pa.binary())], ["a", "b"])

    rows = found.join(members.select("_set", "_sketch"), "_set").select("_path", "_set", "_size", "_sketch")
    dealt = blocked(rows, "_path", "_set", F.greatest(F.lit(1), F.ceil(F.col("_size") / SMALL)))
    return dealt.select("_path", "_bi", "_bj", "_in", "_set", "_sketch").mapInArrow(work, "a binary, b binary").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    found = np.zeros((len(sets), len(sets)))
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(shared.sum()), 4096):
        b, e = np.searchsorted(column, [a, a + 4096])
        slab = np.zeros((len(sets), 4096), np.float32)
        slab[row[b:e], column[b:e] - a] = 1
        found += slab @ slab.T
    return found


def verified(docs: DataFrame, members: DataFrame, groups: DataFrame, threshold: float, doc_id: str, text: str) -> DataFrame:
    """``_set``, ``_low``, ``_links`` by exact comparison within the groups (``node``, ``root``) of candidates.

    A row is one member in one pair of blocks: the number of documents it is linked to
    there, and the member it is linked to as ``_roots`` says, if any.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["root", "_bi", "_bj"]):
            names = t.column("_set").to_pylist()
            # Repeated rows of one document give a member more than once.
            first = list({n: i for i, n in reversed(list(enumerate(names)))}.values())
            t = t.take(pa.array(sorted(first, key=names.__getitem__)))
            names, weight = t.column("_set").to_pylist(), t.column("_copies").to_numpy().astype(float)
            sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in t.column("_shingles")]
            both = overlaps(sets)
            size = np.array([len(s) for s in sets], float)
            near = (both / (size[:, None] + size[None, :] - both) >= threshold) & ~np.eye(len(names), dtype=bool)
            low: list[bytes | None] = [None] * len(names)
            for i, first in zip(*_roots(near, t)):
                low[i] = names[first]
            near &= _across(t)
            at = [i for i in range(len(names)) if low[i] is not None or near[i].any()]
            if at:
                links = near @ weight
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in at], pa.binary()), pa.array([low[i] for i in at], pa.binary()), pa.array(links[at].astype(np.int64))],
                    ["_set", "_low", "_links"],
                )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("_text")]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [column], others + ["_shingles"])
        _hashes.clear()

    others = ["root", "_set", "_copies", "_blocks"]
    sizes = groups.join(members.select(F.col("_set").alias("node"), "_n", "_copies", "_one"), "node")
    number = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("_n") / BLOCK_SHINGLES))
    blocks = sizes.groupBy("root").agg(number.alias("_blocks"))
    wanted = sizes.join(blocks, "root").select("root", F.col("node").alias("_set"), "_copies", "_blocks", "_one.*")
    texts = _keyed(docs, doc_id, text).withColumnRenamed("_id", "_doc")
    texts = texts.join(small_side(wanted), (F.col("_doc").eqNullSafe(F.col("_id"))) & (texts["_text_id"] == F.col("_tid")))
    rows = texts.select(*others, "_text").mapInArrow(again, "root binary, _set binary, _copies long, _blocks long, _shingles array<bigint>")
    dealt = blocked(rows.withColumnRenamed("_blocks", "_number"), "root", "_set", F.col("_number"))
    return dealt.select("root", "_bi", "_bj", "_in", "_set", "_copies", "_shingles").mapInArrow(work, "_set binary, _low binary, _links long")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id``, ``n_copies``, ``n_links``.

    ``class_id`` is the smallest id among all documents that chains of links connect;
    ``n_copies`` the documents with the same shingle set, itself included; ``n_links``
    the other documents at ``threshold`` or more, copies included. Texts without words
    (null, empty, blank) are linked to nothing and are their own class; their ``n_copies``
    is 1. Texts of fewer than five words are one shingle. Ids that repeat count as
    documents of their own; null ids are classed by the smallest id that isn't null.
    Empty tables give no rows; other columns are not read.
    """
    found = _classed(docs, threshold, recall, doc_id, text)
    return found.select(F.col("_id").alias("doc_id"), "class_id", "n_copies", "n_links")


def _classed(docs: DataFrame, threshold: float, recall: float, doc_id: str, text: str) -> DataFrame:
    """The rows of ``join`` with ``_id``, ``_text_id`` and ``_stays``, the id and text of the document that stands for the class."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    if not 0 < recall < 1:
        raise ValueError("the recall must lie between 0 and 1")
    every = pin(sketched(docs, doc_id, text))
    one = F.min(F.struct("_id", F.col("_text_id").alias("_tid"))).alias("_one")
    # The document that stays: the smallest id, a missing one last, then the text.
    first = F.min(F.struct(F.col("_id").isNull().alias("missing"), "_id", F.col("_text_id").alias("_tid"))).alias("_first")
    members = pin(
        every.where("_set is not null").groupBy("_set")
        .agg(F.first("_sketch").alias("_sketch"), F.first("_n").alias("_n"), F.count("*").alias("_copies"), F.min("_id").alias("_least"), one, first)
    )
    found = buckets(members, threshold, runs_needed(threshold, recall))
    groups = pin(components(candidates(members, found, floor_needed(threshold, recall) / POSITIONS)))
    links = pin(verified(docs, members, groups, threshold, doc_id, text))
    classes = components(links.where("_low is not null").select(F.col("_set").alias("a"), F.col("_low").alias("b")))
    counts = links.groupBy("_set").agg(F.sum("_links").alias("_links"))
    known = members.select("_set", "_copies", "_least", "_first").join(classes.withColumnRenamed("node", "_set"), "_set", "left").join(counts, "_set", "left")
    known = known.withColumn("_class", F.coalesce("root", "_set"))
    heads = known.where("root is not null").groupBy("_class").agg(F.min("_least").alias("_head"), F.min("_first").alias("_stays"))
    known = known.join(heads, "_class", "left").select(
        "_set", "_copies", F.coalesce("_stays", "_first").alias("_stays"), F.coalesce("_head", "_least").alias("_class_id"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links")
    )
    out = every.select("_id", "_text_id", "_set").join(known, "_set", "left")
    return out.select(
        "_id", "_text_id", "_stays", F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_class_id")).alias("class_id"),
        F.coalesce("_copies", F.lit(1)).alias("n_copies"), F.coalesce("_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``docs``, in their own columns: that with the smallest id, a missing id last.

    Of rows that repeat id and text one stays, the first by the hash of the whole row. Texts
    without words are linked to nothing and all stay.
    """
    found = _classed(docs, threshold, recall, doc_id, text).where("_stays is not null")
    here = F.col("_id").eqNullSafe(F.col("_stays._id")) & F.col("_text_id").eqNullSafe(F.col("_stays._tid"))
    key = [F.col("_id").alias("_gone"), F.col("_text_id").alias("_gone_text")]
    counted = pin(found.select("_id", "_text_id", here.alias("here")).groupBy("_id", "_text_id", "here").agg(F.count(F.lit(1)).alias("n")))
    gone, repeated = (small_side(counted.where(c).select(*key)) for c in ("not here", "here and n > 1"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.md5(F.col(f"`{text}`").cast("binary")).alias("_text_id"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & F.col("_text_id").eqNullSafe(F.col("_gone_text"))
    left = rows.join(gone, same, "left_anti")
    # Partly aggregated before the shuffle, so a row repeated without end is one row of each task.
    several = left.join(repeated, same, "left_semi").groupBy("_id", "_text_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return left.join(repeated, same, "left_anti").select("_row.*").unionByName(several.select("_row.*"))
