"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records,
followed by a skippable frame that holds the seek table: compressed and plain size of
every frame. The index table maps a record identifier to its bundle, frame and offset
within the frame, so one record costs one ranged read of one frame.

Tasks write their own rows in input order; bundles are opened through the file system
that their address names, under a name of their own per attempt. Only bundles that the
index names belong to the archive, so files of lost or repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from understory.llm.common import aside, small_side
from understory.session import scratch_path

#: Plain bytes after which a frame is closed, and bytes of a bundle after which the next one starts.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Plain bytes of the records that a task reads, about.
TASK_BYTES = 16 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the format: the profile of a record that repeats an earlier payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame long, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, payload binary, refers_to string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record with its closing blank lines. A revisit has no payload but the digest of its own."""
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        headers.append(("WARC-Target-URI", _clean(uri)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"))
    if refers_to:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")]
    body = b"" if refers_to else payload
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``start``."""
    cut = data.index(b"\r\n\r\n", start)
    head = data[start:cut].decode().split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError("no record here")
    headers = dict(line.split(": ", 1) for line in head[1:])
    end = cut + 4 + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    return headers, data[cut + 4 : end], end + 4


def _open(address: str, mode: str):
    """File at an address of any kind that Arrow knows (file, hdfs, s3, gs), and its folder made."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


class Bundle:
    """Writer of one bundle."""

    def __init__(self, address: str, level: int):
        self.address, self.out = address, _open(address, "w")
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.at, self.plain, self.filled, self.waiting = 0, [], 0, []

    def add(self, record_id: str, data: bytes) -> None:
        self.waiting.append((record_id, self.filled, len(data)))
        self.plain.append(data)
        self.filled += len(data)

    def flush(self) -> list[tuple]:
        """Closes the frame; rows of the index for its records."""
        if not self.waiting:
            return []
        packed = self.press.compress(b"".join(self.plain))
        self.out.write(packed)
        rows = [(i, self.address, len(self.sizes), self.at, len(packed), offset, length) for i, offset, length in self.waiting]
        self.sizes.append((len(packed), self.filled))
        self.at += len(packed)
        self.plain, self.filled, self.waiting = [], 0, []
        return rows

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(address: str) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of every frame, from the footer alone."""
    with _open(address, "r") as f:
        size = f.size()
        frames, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{address} has no seek table that this reader knows")
        entries = f.read_at(8 * frames, size - 9 - 8 * frames)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_one(address: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record by its place in the index, with two ranged reads."""
    start, packed, plain = seek_table(address)[frame]
    with _open(address, "r") as f:
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=plain)
    return parse(data, offset)[:2]


def write_archive(records: DataFrame, folder: str, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes ``records`` (``record_id``, ``target_uri``, ``payload`` binary, ``refers_to`` of a revisit or
    null) and returns the index table, itself written to ``folder``/index. Nothing is shuffled; a task
    holds one frame and one Arrow batch. A null payload counts as empty; a null address is left out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), *[(n, pa.int64()) for n in ("frame", "frame_start", "frame_bytes", "offset", "length")]])
        as_batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
        bundle, rows = None, []
        for batch in batches:
            for i, uri, payload, first in zip(*(batch.column(c) for c in ("record_id", "target_uri", "payload", "refers_to"))):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", level)
                payload = payload.as_py() or b""
                bundle.add(i.as_py(), record(i.as_py(), uri.as_py(), payload, first.as_py()))
                if bundle.filled >= frame_bytes:
                    rows += bundle.flush()
                if bundle.at >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if len(rows) >= 10_000:
                yield as_batch(rows)
                rows = []
        if bundle is not None:
            rows += bundle.flush()
            bundle.close()
        yield as_batch(rows)

    columns = records.select("record_id", "target_uri", "payload", "refers_to")
    # Written, not only planned: computing the index again would write the bundles again.
    columns.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def read_archive(index: DataFrame) -> DataFrame:
    """All records that ``index`` names, as ``record_id``, ``record_type``, ``target_uri``, ``payload_digest``,
    ``payload``, ``refers_to``. Every frame is one row, read and unpacked by one task; checked against the
    bundle's own seek table and the index offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "payload_digest", "payload", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        unpack, tables = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] not in tables:
                    tables = {row["bundle"]: seek_table(row["bundle"])}
                start, packed, plain = tables[row["bundle"]][row["frame"]]
                if (start, packed) != (row["frame_start"], row["frame_bytes"]):
                    raise ValueError(f"the seek table of {row['bundle']} and the index disagree")
                with _open(row["bundle"], "r") as f:
                    data = unpack.decompress(f.read_at(packed, start), max_output_size=plain)
                out = [[] for _ in names]
                for offset in sorted(row["offsets"]):
                    headers, payload, _ = parse(data, offset)
                    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't the one that was written")
                    values = (
                        headers["WARC-Record-ID"][1:-1], headers["WARC-Type"], headers.get("WARC-Target-URI"),
                        headers["WARC-Payload-Digest"].removeprefix("sha1:"), payload, headers.get("WARC-Refers-To", "<>")[1:-1] or None,
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    frames = index.groupBy("bundle", "frame", "frame_start", "frame_bytes").agg(F.collect_list("offset").alias("offsets"))
    # Dealt by the bytes to be read, which Spark can't see in the few bytes of the index.
    size = index.select(F.sum(F.col("length")).alias("n")).first()["n"] or 0
    return frames.repartition(max(1, -(-size // TASK_BYTES)), "bundle", "frame").mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", uri: str = "url", payload: str = "html", at_least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the archive's index.

    Of rows with equal payloads of ``at_least`` bytes or more, the one with the smallest
    id is a response and the others revisit it. Rows that repeat that id and payload
    are responses too. A null payload is empty, a null id sorts before all others, and
    its record refers by the id ``null``. Empty tables give an empty index. Without a
    ``folder`` the archive goes to the shared folder of the session.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("null")).alias("_name"), F.col(f"`{page_id}`").alias("_id"),
        F.col(f"`{uri}`").alias("target_uri"), body.alias("payload"), F.sha1(body).alias("_sha"), F.octet_length(body).alias("_n"),
    )
    # Numbers only, partly aggregated: a payload with many copies is one row a task.
    order = F.struct(F.col("_id").alias("i"))
    firsts = keyed.where(F.col("_n") >= at_least).groupBy("_sha", "_n").agg(F.count("*").alias("n"), F.min(order).alias("_first")).where("n > 1")
    firsts = small_side(firsts.select("_sha", "_n", F.col("_first.i").alias("_first"), F.lit(True).alias("_shared")))
    joined = keyed.join(firsts, ["_sha", "_n"], "left")
    revisits = F.col("_shared") & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    records = joined.select(name(F.col("_id")).alias("record_id"), "target_uri", "payload", F.when(revisits, name(F.col("_first"))).alias("refers_to"))
    return write_archive(records, folder)
