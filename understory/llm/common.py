"""Helpers that several operators share: rows kept aside, let-bindings, checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from understory.session import pin

#: Largest side, in bytes of its values, that is ever broadcast.
BROADCAST_BYTES = 32 << 20


def aside(df: DataFrame, **columns: Column) -> DataFrame:
    """``_row`` with every column of ``df``, beside the named working columns.

    Operators work on the named columns only, so no extra column of the caller can
    clash with theirs; ``_row.*`` gives the caller's columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the named columns, each computed once a row.

    A plain projection may be merged into what uses it, and a filter on it moved below
    it; costly expressions are then computed again. A generator stays where it is.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as text, a bound of what a broadcast holds."""
    found = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long") + 32).alias("n")).first()
    return int(found["n"] or 0)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; hinted for broadcast only if it measures under the limit.

    Beyond the limit the join is left to Spark, which shuffles both sides and splits skewed partitions.
    """
    pinned = pin(df)
    return F.broadcast(pinned) if bytes_of(pinned) <= BROADCAST_BYTES else pinned


#: Edges of a node beyond which it is a hub, and hubs at most, as a share of all edges.
HUB_EDGES, HUB_SHARE = 10_000, 50_000


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for undirected ``edges`` (``a``, ``b``): the smallest node of each connected component.

    Large-star and small-star steps in turn; every step shuffles edges only. Nodes
    with so many edges that there can only be few of them get their smallest neighbour by
    broadcast, so their edges stay where they are. Ends when no edge changes.
    """
    star = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _print(star)
    while True:
        limit = max(HUB_EDGES, seen[0] // HUB_SHARE)
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_low(both.where("v > u"), low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _with_low(large, own, limit).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        star = pin(small)
        now = _print(star)
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _with_low(edges: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u`` from ``low`` (``u``, ``m``, ``n``); those of hubs, with more than ``limit`` edges, aren't shuffled.

    There are at most twice ``HUB_SHARE`` hubs, as few as one in ``limit`` edges.
    """
    hubs = low.where(F.col("n") > limit).select("u", "m").toArrow()
    if not hubs.num_rows:
        return edges.join(low.select("u", "m"), "u").select("u", "v", "m")
    known = F.broadcast(edges.sparkSession.createDataFrame(hubs))
    rest = edges.join(known, "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return edges.join(known, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
