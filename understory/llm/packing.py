"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``LINEAR`` n + ``QUADRATIC`` n^2: layers are linear, attention
inside the piece is quadratic. Tasks take their documents in bins of about ``BIN_TOKENS``
tokens. In a bin the pieces, in descending order, go to the sequence of the lowest cost
that has room left; what exceeds the room is cut off and takes its place in the order
again. The bin opens as many sequences as its tokens fill, and what they exceed a
multiple of the capacity by lies in sequences of a power of two tokens, which needn't be
padded. So no sequence is padded at all, and every sequence costs about the same.

Nothing is shuffled: a bin holds a bounded number of tokens, and more documents are
more bins.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from understory.llm import byte_tokens

CAPACITY = 1024
#: Cost of a token and of a pair of tokens, in sixths of the layers' cost of a width of 1024.
LINEAR, QUADRATIC = 6144, 1
BIN_TOKENS = 1 << 20
#: Id that ends a document.
END = 0

PIECE = (
    ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()),
)


def cost(n: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> int:
    return linear * n + quadratic * n * n


def rooms(total: int, capacity: int) -> list[int]:
    """Tokens of each sequence that a bin opens: full ones, then the powers of two that make up the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack_bin(sizes: np.ndarray, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) in the order of documents and starts, for documents of these sizes."""
    room = rooms(int(sizes.sum()), capacity)
    # Pieces that fill a sequence come first in the order, and each meets an empty one.
    full = sizes // capacity
    doc = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    done = np.column_stack([doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)])
    pieces = [(-int(n % capacity), d, int(n - n % capacity)) for d, n in enumerate(sizes) if n % capacity]
    heapq.heapify(pieces)
    # A shorter sequence starts with the linear cost of what it lacks, so that it ends like the others.
    open_ = [(linear * (capacity - room[s]), s) for s in range(len(doc), len(room))]
    heapq.heapify(open_)
    size, placed = list(room), []
    while pieces:
        short, d, start = heapq.heappop(pieces)
        spent, s = heapq.heappop(open_)
        n = min(-short, room[s])
        placed.append((d, start, n, s, size[s] - room[s]))
        room[s] -= n
        if room[s]:
            heapq.heappush(open_, (spent + cost(n, linear, quadratic), s))
        if n < -short:
            heapq.heappush(pieces, (short + n, d, start + n))
    rows = np.concatenate([done, np.array(placed, np.int64).reshape(-1, 5)])
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = CAPACITY,
    linear: int = LINEAR,
    quadratic: int = QUADRATIC,
    bin_tokens: int = BIN_TOKENS,
) -> DataFrame:
    """Pieces of all documents: the columns in ``keep``, then ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids by the byte-level tokenizer file at ``path`` (special tokens in
    a text are themselves) and then id 0; null and empty texts are that id alone. ``ids``
    holds a piece's ids as little-endian unsigned 32-bit integers. Every id lies in one
    piece. ``sequence_id`` is unique, not consecutive. Repeated rows, and rows whose key is
    null, are documents of their own; an empty table has no pieces. Columns of ``docs``
    outside ``keep`` play no part, whatever their names; one in ``keep`` must not have a
    name of the outputs. A task's bins follow its rows, so give it a table read from files
    if tasks that run again are to find the same sequences.
    """
    if set(keep) & {n for n, _ in PIECE}:
        raise ValueError("a kept column has the name of an output")
    tokens = byte_tokens.load(docs.sparkSession, path)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t in PIECE])

    def close(held, found, first):
        """The bin's pieces, and how many sequences they take."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        placed = pack_bin(sizes, capacity, linear, quadratic)
        doc, start, length, sequence, offset = placed.T
        # In the order of documents and starts, the pieces' ids are all ids of the bin.
        ends = pa.array(np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32))
        ids = pa.py_buffer(np.concatenate(found).astype("<u4", copy=False))
        kept = pa.Table.from_batches(held).take(pa.array(doc)).combine_chunks().columns
        columns = [
            *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept], pa.array(start), pa.array(length),
            pa.Array.from_buffers(pa.binary(), len(placed), [None, ends.buffers()[1], ids]), pa.array(sizes[doc]),
            pa.array(sequence + first), pa.array(offset),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names), int(sequence.max()) + 1

    def run(batches):
        encoder, end = tokens(), np.array([END], np.uint32)
        first, held, found, n = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column("text")):
                found.append(np.concatenate([encoder.encode(value.as_py() or "", specials=True), end]))
                n += len(found[-1])
                if n >= bin_tokens:
                    held.append(batch.slice(start, i + 1 - start).drop_columns(["text"]))
                    out, opened = close(held, found, first)
                    yield out
                    start, first, held, found, n = i + 1, first + opened, [], [], 0
            if start < batch.num_rows:
                held.append(batch.slice(start).drop_columns(["text"]))
        if found:
            yield close(held, found, first)[0]

    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Per sequence of a packing: ``sequence_id``, ``tokens``, ``pieces`` and ``cost`` at the default weights."""
    n = F.col("length")
    return pieces.groupBy("sequence_id").agg(
        F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(n * F.lit(LINEAR) + n * n * F.lit(QUADRATIC)).alias("cost")
    )
