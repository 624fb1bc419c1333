"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed to 128 bits. A window found more than once in
the corpus covers its three lines at every occurrence but the first, in the order of
document id (missing ones last), row and line. Covered positions are merged, so a repeated
passage of any length goes as a whole, and its first occurrence stays, but for the lines
of it that a later window overlapping it covers: five equal lines leave one. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from understory.llm.common import aside, let, once, small_side
from understory.llm.quality import BLANKS

WINDOW = 3


def _lines(text: Column) -> Column:
    """Lines without their outer blanks."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _window_hashes(text: Column, window: int) -> Column:
    """Two hashes for each window of the lines that aren't blank. No window leaves its document."""

    def hashes(ls: Column) -> Column:
        def pairs(hs: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(hs) - (window - 1))
            two = lambda part: F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), part).alias("b"))
            none = F.array().cast("array<struct<a:bigint,b:bigint>>")
            return F.when(F.size(hs) < window, none).otherwise(F.transform(starts, lambda i: two(F.slice(hs, i, window))))

        return let(F.transform(ls, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))), pairs)

    return let(F.filter(_lines(text), lambda x: x != ""), hashes)


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_no``, ``_at``: starts of the windows that are not the first of their hashes.

    ``docs`` has ``_id``, ``_no`` and ``_text``. Rows are a few numbers each. The
    first occurrence of a repeated window comes from a partly aggregated minimum and
    is joined back to the occurrences, whose side Spark splits where a passage is hot.
    """
    places = docs.select("_id", "_no", F.posexplode(_window_hashes(F.col("_text"), window)).alias("_at", "_hash"))
    places = places.select("_id", "_no", "_at", F.col("_hash.a").alias("_a"), F.col("_hash.b").alias("_b"))
    place = F.struct(F.col("_id").isNull().alias("missing"), "_id", "_no", "_at")
    firsts = places.groupBy("_a", "_b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = places.join(firsts.select("_a", "_b", F.col("first._no").alias("_first"), F.col("first._at").alias("_first_at")), ["_a", "_b"])
    return again.where((F.col("_no") != F.col("_first")) | (F.col("_at") != F.col("_first_at"))).select("_no", "_at")


def _cut(text: Column, starts: Column, window: int) -> Column:
    """Struct of the lines left and their number before; every step is linear in the lines."""

    def left(ls: Column) -> Column:
        def without(solid: Column) -> Column:
            covered = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.get(solid, s + k))))
            stays = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), covered)
            return F.transform(stays, lambda i: F.get(ls, i))

        numbered = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.btrim(F.get(ls, i), F.lit(BLANKS)) != "")
        return let(numbered, without)

    return let(F.split(text, "\n", -1), left)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``_row`` (the row as it came), ``clean`` (the text left), ``n_lines`` that aren't blank, ``n_removed`` of them.

    Lines are compared without their outer blanks; blank lines are no part of windows
    and stay. Texts of fewer than ``window`` such lines stay whole. A null text stays
    null with no lines. Rows that repeat an id, and rows with null ids, which come after all
    others, are documents of their own: the first keeps what the others lose. Empty
    tables give no rows; extra columns stay inside ``_row``.

    Rows with one id are told apart by their place in the table, which is read twice:
    ``docs`` should be a table read from files, or a checkpoint.
    """
    id_, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    numbered = aside(docs, _id=id_, _text=body, _no=F.monotonically_increasing_id())
    starts = small_side(later_windows(numbered.select("_id", "_no", "_text"), window).groupBy("_no").agg(F.collect_set("_at").alias("_starts")))
    joined = numbered.join(starts, "_no", "left")
    solid = lambda t: F.size(F.filter(_lines(t), lambda x: x != "")).cast("long")
    cut = F.when(F.col("_starts").isNull(), F.col("_text")).otherwise(F.array_join(_cut(F.col("_text"), F.col("_starts"), window), "\n"))
    found = once(joined, ["_row", "_text"], clean=cut)
    out = once(found, ["_row", "clean"], n_lines=solid(F.col("_text")), n_left=solid(F.col("clean")))
    return out.select("_row", "clean", "n_lines", (F.col("n_lines") - F.col("n_left")).alias("n_removed"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` without later occurrences, in its own columns. A document of which nothing
    but blanks is left goes, since all it said stands in earlier ones; one that came
    without any word stays. ``length`` becomes the code points of the text left."""
    found = dedup(docs, doc_id, text, window).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {text: F.col("clean"), length: F.length("clean").cast("long")}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
