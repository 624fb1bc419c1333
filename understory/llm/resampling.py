"""Importance resampling towards a target distribution, on hashed word n-grams.

A feature is a run of one or two words; its bucket is the CRC of its bytes. The log
ratio of a bucket's shares in the target and in the documents is its gain, the mean of a
document's gains is its weight, and weight plus Gumbel noise keyed by the document is
its score; the highest scores are a sample without replacement by the weights.

CRCs are computed for the distinct features of an Arrow batch at once: features of equal
length are a matrix of bytes, whose CRCs advance column by column, and results are
scattered back. Buckets of every document are written once, so that counts and weights
read them and not the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from understory.operators.gram import batch_sums
from understory.session import pin, scratch_path

BUCKETS = 10_000
#: Percent of the documents of at least so many words that are drawn, and the key of the noise.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Bytes of text whose distinct features are hashed at once.
PART_BYTES = 1 << 20

# A-Z become a-z, digits and bytes beyond ASCII stay, all else separates words.
_letters = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_table = _crc_table()


def crc_matrices(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``flat[start : start + length]`` for every start and length.

    Strings are bucketed by length; the CRCs of a bucket advance one column of its matrix at a time.
    """
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
        rows = order[a:b]
        matrix = flat[starts[rows][:, None] + np.arange(size)]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(size):
            crc = _table[(crc ^ matrix[:, k]) & 0xFF] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


class _Numbers(dict):
    """Numbers of words in the order met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_letters).split()


def _crcs(words: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of distinct words and of distinct pairs of them (rows of two numbers), joined by a blank."""
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)  # every word has a blank behind it
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    single = crc_matrices(flat, starts, lengths)
    left, right = pairs.T
    sizes = lengths[left] + 1 + lengths[right]
    begin = np.cumsum(sizes) - sizes
    joined = np.empty(int(sizes.sum()), np.uint8)
    for which, at, more in ((left, begin, 1), (right, begin + lengths[left] + 1, 0)):
        n = lengths[which] + more
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        joined[np.repeat(at, n) + inner] = flat[np.repeat(starts[which], n) + inner]
    return single, crc_matrices(joined, begin, sizes)


def buckets_of(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features in the texts' order)."""
    numbers = _Numbers()
    split = [words_of(t) for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    n_features = np.maximum(2 * n_words - 1, 0)
    total = int(n_words.sum())
    if not total:
        return n_words, n_features, np.zeros(0, np.int64)
    single = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, total)
    last = np.cumsum(n_words)[n_words > 0] - 1
    inside = np.ones(total, bool)
    inside[last] = False  # a text's last word starts no pair
    at = np.flatnonzero(inside)
    codes, double = np.unique(single[at] * len(numbers) + single[at + 1], return_inverse=True)
    words_crc, pairs_crc = _crcs(list(numbers), np.column_stack([codes // len(numbers), codes % len(numbers)]))
    # A text's words, then its pairs.
    text = np.repeat(np.arange(len(split)), n_words)
    first = np.cumsum(n_features) - n_features
    before = np.cumsum(n_words) - n_words
    nth = np.arange(total) - before[text]
    out = np.empty(int(n_features.sum()), np.int64)
    out[first[text] + nth] = words_crc[single] % buckets
    out[(first + n_words)[text[at]] + nth[at]] = pairs_crc[double] % buckets
    return n_words, n_features, out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in parts of about ``PART_BYTES`` of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = np.cumsum(size, dtype=np.int64) // PART_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def hashed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS) -> DataFrame:
    """``keep``, ``n_words``, ``n_features`` and ``buckets`` (packed integers) of every row. Null texts have no words."""
    if not 0 < buckets <= 1 << 32:
        raise ValueError("a CRC has 32 bits")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    kind = packed_type(buckets)
    more = (("n_words", T.LongType()), ("n_features", T.LongType()), ("buckets", T.BinaryType()))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            n_words, n_features, found = buckets_of(batch.column("text").to_pylist(), buckets)
            ends = pa.array(np.concatenate([[0], kind.itemsize * np.cumsum(n_features)]).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(found.astype(kind))])
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n_features), packed], schema.names)

    return rows.mapInArrow(run, schema)


def packed_type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _flat(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("buckets").to_pylist()), kind)


def bucket_sums(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket over all rows of a hashed table; one number a bucket reaches the driver."""
    kind = packed_type(buckets)

    def part(batch):
        yield 0, np.bincount(_flat(batch, kind), minlength=buckets).astype(float)

    sums = np.zeros(buckets)
    for row in batch_sums(table.select("buckets"), part).where("total > 0").select("pos", "total").collect():
        sums[row["pos"]] = row["total"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of the smoothed shares of every bucket, floored."""
    n, s, t = float(len(source)), source.sum(), target.sum()
    return np.floor(1000.0 * np.log((target + 1.0) * (s + n) / ((source + 1.0) * (t + n)))).astype(np.int64)


def weigh(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """A hashed table with ``weight``, the floored mean of its features' gains (none: 0), in place of ``buckets``."""
    kind = packed_type(len(gain))
    shared = table.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([f for f in table.schema.fields if f.name != "buckets"] + [T.StructField("weight", T.LongType())])

    def run(batches):
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(shared.value[_flat(batch, kind)])])
            ends = np.cumsum(n)
            mean = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["buckets"]).columns, pa.array(mean)], schema.names)

    return table.mapInArrow(run, schema)


def noise(key: str, seed: int = SEED):
    """Thousand times a Gumbel deviate, floored, as a function of the key and the seed. A null key counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _places(batches):
    """Place of each row in its sorted partition, and the partition."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])


def _in_order(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place from zero in a global order. A range of the order is a partition; one number each reaches the driver."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    placed = pin(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, schema))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    starts = accumulate([0, *[n for _, n in sizes]])
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, first long")
    return placed.join(F.broadcast(offsets), "part").withColumn("place", F.col("place") + F.col("first")).drop("part", "first")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; those drawn have a rank.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are
    drawn, by descending score, ties by ascending key; nulls come first. Null and empty texts have no features
    and weight 0. Rows with one key have one noise; of rows equal in key and score any is
    first. An empty table gives no rows, an empty target counts as no features.
    Other columns of ``docs`` play no part.
    """
    if key in ("n_words", "n_features", "buckets", "weight", "score", "rank"):
        raise ValueError("the key has the name of an output")
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "hashed-features")
    hashed(docs, text, (key,), buckets).write.parquet(path)
    table = spark.read.parquet(path)
    aim = bucket_sums(hashed(target, target_text, (), buckets), buckets)
    weighed = weigh(table, gains(bucket_sums(table, buckets), aim))
    scored = pin(
        weighed.select(
            F.col(f"`{key}`").alias("k"), "n_features", "weight", (F.col("weight") + noise(key, seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("id"),
        )
    )
    able = scored.where("able")
    drawn = percent * able.count() // 100
    # Equal keys with equal scores are dealt by a number of their own, or they would meet in one task.
    placed = _in_order(able, F.desc("score"), F.asc("k"), F.asc("id"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    both = placed.withColumn("rank", rank).drop("place").unionByName(scored.where("not able").withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("k").alias(key), "n_features", "weight", "score", "rank")
