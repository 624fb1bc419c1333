"""Sums and effects over a tree by contraction: leaves up and root down, in rounds that don't grow with the depth.

What a node's subtree says of the node's value is a precision and a weighted mean. Along a
branch they change by a fractional-linear map, and such maps compose to one of the same
form, so branches in a row can be drawn together before the values below are known. Each
round takes every leaf in (rake) and an independent part of the nodes with a single child
out (compress), so a tree of any shape is gone after rounds in the order of log(nodes).
Nodes taken out get their values afterwards, in the reverse order of rounds. The way
down is a composition of affine maps along root paths, whose reach doubles each round. What
is left of a tree is folded at the driver once it has at most ``SMALL`` nodes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from understory.operators.tree import tip_factor, tips, vcv
from understory.session import pin

#: Nodes up to which what is left of a tree is folded at the driver.
SMALL = 1 << 16
#: P -> (al P + be) / (ga P + de); h -> (ka h + la P + mu) / (ga P + de); ld -> ld + ln(ga P + de) + lc.
MAP = ("al", "be", "ga", "de", "ka", "la", "mu", "lc")
OWN = ("c", "h", "ld", "n")


def _coin(node: str, number: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(number)), F.lit(2)) == 1


def _applied(prefix: str, p: Column, h: Column, ld: Column) -> tuple[Column, Column, Column]:
    """What a map makes of a node's values."""
    m = {k: F.col(prefix + k) for k in MAP}
    below = m["ga"] * p + m["de"]
    return (m["al"] * p + m["be"]) / below, (m["ka"] * h + m["la"] * p + m["mu"]) / below, ld + F.ln(below) + m["lc"]


def _composed() -> dict[str, Column]:
    """Map of the child (``d_``), then what the node holds (``c_`` own), then the node's map (``c_``), scaled against overflow."""
    d, c = ({k: F.col(f"{x}_{k}") for k in (*MAP, *OWN)} for x in "dc")
    # Numerators and denominator after the node's own values are added, as (factor of P, constant) or (of h, of P, constant).
    al, be = d["al"] + c["c"] * d["ga"], d["be"] + c["c"] * d["de"]
    ka, la, mu = d["ka"], d["la"] + c["h"] * d["ga"], d["mu"] + c["h"] * d["de"]
    found = {
        "al": c["al"] * al + c["be"] * d["ga"], "be": c["al"] * be + c["be"] * d["de"],
        "ga": c["ga"] * al + c["de"] * d["ga"], "de": c["ga"] * be + c["de"] * d["de"],
        "ka": c["ka"] * ka, "la": c["ka"] * la + c["la"] * al + c["mu"] * d["ga"], "mu": c["ka"] * mu + c["la"] * be + c["mu"] * d["de"],
    }
    size = F.greatest(found["ga"], found["de"])
    return {k: v / size for k, v in found.items()} | {"lc": d["lc"] + c["ld"] + c["lc"] + F.ln(size)}


def _finish(rows: list) -> tuple[dict, list[tuple[str, float, float]]]:
    """The root's totals, and (node, P, h) of the others, of a tree of a checked size."""
    nodes = {r["node"]: r.asDict() for r in rows}
    waiting = dict.fromkeys(nodes, 0)
    for r in rows:
        if r["parent"] is not None:
            waiting[r["parent"]] += 1
    ready, done = [n for n, k in waiting.items() if not k], []
    tops = [r for r in nodes.values() if r["parent"] is None]
    for name in ready:  # grows as children are done
        r = nodes[name]
        if r["parent"] is None:
            continue
        done.append((name, r["c"], r["h"]))
        up, below = nodes[r["parent"]], r["ga"] * r["c"] + r["de"]
        up["h"] += (r["ka"] * r["h"] + r["la"] * r["c"] + r["mu"]) / below
        up["c"] += (r["al"] * r["c"] + r["be"]) / below
        up["ld"] += r["ld"] + math.log(below) + r["lc"]
        up["n"] += r["n"]
        waiting[r["parent"]] -= 1
        if not waiting[r["parent"]]:
            ready.append(r["parent"])
    if len(tops) != 1 or len(done) + 1 != len(nodes):
        raise ValueError("the tree has a cycle, or not one root")
    return tops[0], done


def contract(nodes: DataFrame, keep: bool = True) -> tuple[dict, DataFrame | None, int]:
    """(root's totals, ``(node, p, h)`` of every other node, rounds) of a tree of nodes with what they hold themselves.

    ``nodes`` has ``node``, ``parent`` (null for the one root), ``v`` (variance along the branch to the parent),
    ``c``, ``h`` (own precision and weighted value), ``ld`` and ``n``, which are added up. Without ``keep`` only the root's totals are found.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    state = pin(
        nodes.select(
            "node", "parent", one.alias("al"), zero.alias("be"), F.col("v").alias("ga"), one.alias("de"),
            one.alias("ka"), zero.alias("la"), zero.alias("mu"), zero.alias("lc"), *OWN,
        )
    )
    raked, compressed, left, rounds = [], [], state.count(), 0
    if left == 0:
        raise ValueError("the tree has no nodes")
    while left > max(SMALL, 1):
        parents = state.where("parent is not null").select(F.col("parent").alias("node")).distinct()
        leaves = pin(state.where("parent is not null").join(parents, "node", "left_anti"))
        if leaves.isEmpty():
            raise ValueError("the tree has a cycle, or more than one root")
        raked.append(leaves.select("node", F.col("c").alias("p"), "h"))
        p, h, ld = _applied("", F.col("c"), F.col("h"), F.col("ld"))
        given = leaves.select("parent", p.alias("c"), h.alias("h"), ld.alias("ld"), "n").groupBy("parent").agg(*[F.sum(k).alias(f"g_{k}") for k in OWN])
        rest = state.join(leaves.select("node"), "node", "left_anti").join(given.withColumnRenamed("parent", "node"), "node", "left")
        rest = pin(rest.select("node", "parent", *MAP, *[(F.col(k) + F.coalesce(F.col(f"g_{k}"), F.lit(0))).alias(k) for k in OWN]))
        # Nodes with one child left, of which those go whose coin is up and whose parent's is down.
        only = rest.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("child")).where("k = 1")
        out = rest.where(F.col("parent").isNotNull() & _coin("node", rounds) & ~_coin("parent", rounds)).join(only.select("node", "child"), "node")
        child = rest.select(F.col("node").alias("child"), *[F.col(k).alias(f"d_{k}") for k in (*MAP, "n")])
        merged = pin(out.select("node", "parent", "child", *[F.col(k).alias(f"c_{k}") for k in (*MAP, *OWN)]).join(child, "child"))
        if keep:
            compressed.append(merged)
        drawn = merged.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("c_n").alias("more"), *[v.alias(f"m_{k}") for k, v in _composed().items()])
        state = rest.join(merged.select("node"), "node", "left_anti").join(drawn, "node", "left")
        state = pin(
            state.select(
                "node", F.coalesce("up", "parent").alias("parent"), *[F.coalesce(f"m_{k}", k).alias(k) for k in MAP],
                "c", "h", "ld", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
            )
        )
        left, rounds = state.count(), rounds + 1
    root, last = _finish(state.collect())  # at most SMALL nodes
    if not keep:
        return root, None, rounds
    raked.append(state.sparkSession.createDataFrame(last, "node string, p double, h double"))
    known = reduce(DataFrame.unionByName, raked)
    for merged in reversed(compressed):
        if merged.isEmpty():
            continue
        p, h, _ = _applied("d_", F.col("p"), F.col("h"), F.lit(0.0))
        found = merged.join(known.withColumnRenamed("node", "child"), "child").select("node", (F.col("c_c") + p).alias("p"), (F.col("c_h") + h).alias("h"))
        known = pin(known.unionByName(found))
    return root, known, rounds


def rooted(edges: DataFrame) -> DataFrame:
    """``node``, ``parent``, ``v`` of every node of an edge table; the root's parent is null."""
    below = edges.select(F.col("child").alias("node"), "parent", F.col("length").cast("double").alias("v"))
    top = edges.select(F.col("parent").alias("node")).distinct().join(below.select("node"), "node", "left_anti")
    return below.unionByName(top.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("v")))


def log_determinant(edges: DataFrame) -> DataFrame:
    """Log determinant of the tip covariance and the number of tips, as one row; the matrix is never built.

    Tip branches must be longer than zero. A tip says all of its own value, so its parent gets
    the branch's precision; what remains is the tree of inner nodes.
    """
    edges = pin(edges)
    ends = tips(edges).withColumnRenamed("tip", "node")
    every = rooted(edges)
    t = F.col("v")
    given = every.join(ends, "node", "left_semi").groupBy(F.col("parent").alias("node")).agg(
        F.sum(1 / t).alias("c"), F.sum(F.when(t > 0, F.ln(t))).alias("ld"), F.count(F.lit(1)).alias("n")
    )
    inner = every.join(ends, "node", "left_anti").join(given, "node", "left")
    none = F.lit(0.0)
    root, _, _ = contract(inner.select("node", "parent", "v", F.coalesce("c", none).alias("c"), none.alias("h"), F.coalesce("ld", none).alias("ld"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), keep=False)
    return edges.sparkSession.createDataFrame([(float(root["ld"]), int(root["n"]))], "log_det double, n_tips long")


def _climb(state: DataFrame, top: str, composed: dict[str, Column]) -> DataFrame:
    """Rows (``node``, ``up``, ...) composed along the ways to the root ``top``. The reach doubles each round.

    ``composed`` gives a column from a node's own and, with ``_`` behind its name, the one of the node it reaches; null at the root.
    """
    state = pin(state)
    while not state.where(F.col("up") != F.lit(top)).isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("further"), *[F.col(c).alias(f"{c}_") for c in composed])
        both = state.join(above, "up", "left")
        state = pin(both.select("node", F.coalesce("further", "up").alias("up"), *[v.alias(c) for c, v in composed.items()]))
    return state


def product(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """The tips' covariance times a vector (``tip``, ``x``), as ``(tip, y)`` for every tip.

    Sums below each branch by contraction, then their products with the branch lengths added
    up along the ways to the root: a row per node and round, and neither pairs of tips nor
    pairs of a tip and a branch. Tips without an ``x`` count zero.
    """
    edges = pin(edges)
    every, none = pin(rooted(edges)), F.lit(0.0)
    given = vector.select(F.col("tip").alias("node"), F.col("x").cast("double").alias("x")).groupBy("node").agg(F.sum("x").alias("x"))
    # Without precision or variance the weighted value is a plain sum.
    filled = every.join(given, "node", "left").select(
        "node", "parent", none.alias("v"), none.alias("c"), F.coalesce("x", none).alias("h"), none.alias("ld"), F.lit(0).cast("long").alias("n")
    )
    root, known, _ = contract(filled)
    state = every.where("parent is not null").join(known, "node").select("node", F.col("parent").alias("up"), (F.col("v") * F.col("h")).alias("y"))
    state = _climb(state, root["node"], {"y": F.col("y") + F.coalesce("y_", none)})
    return state.join(tips(edges).withColumnRenamed("tip", "node"), "node", "left_semi").select(F.col("node").alias("tip"), "y")


def tip_effects(sums: DataFrame, edges: DataFrame, within: float, between: float) -> DataFrame:
    """Effects of the tips under the tree's covariance: ``(tip, n, estimate, est_error)`` for every tip of the tree.

    ``sums`` has ``tip``, ``n`` (weight) and ``s`` (weighted sum) of residuals with
    variance ``within`` / weight; effects have the covariance ``between`` times the shared
    branch lengths. Both are conditional means and deviations given all sums; tips without
    a sum get theirs from their relatives. Sums of labels that aren't tips are an error.
    """
    if not (within > 0 and between >= 0):
        raise ValueError("variances must be positive")
    edges = pin(edges)
    ends = tips(edges)
    own = sums.select(F.col("tip").alias("node"), F.col("n").cast("double").alias("w"), F.col("s").cast("double").alias("s"))
    strange = own.join(ends.withColumnRenamed("tip", "node"), "node", "left_anti").count()
    if strange:
        raise ValueError(f"{strange} labels are no tips of the tree")
    every = pin(rooted(edges).withColumn("v", F.col("v") * F.lit(float(between))))
    none = F.lit(0.0)
    filled = every.join(own, "node", "left").select(
        "node", "parent", "v", (F.coalesce("w", none) / F.lit(float(within))).alias("c"),
        (F.coalesce("s", none) / F.lit(float(within))).alias("h"), none.alias("ld"), F.lit(0).cast("long").alias("n"),
    )
    root, known, _ = contract(filled)
    grown = 1 + F.col("v") * F.col("p")
    # Value of a node given its parent's: a z + b, with variance w; composed up to the root, whose value is zero.
    state = every.where("parent is not null").join(known, "node").select(
        "node", F.col("parent").alias("up"), (1 / grown).alias("a"), (F.col("v") * F.col("h") / grown).alias("b"), (F.col("v") / grown).alias("w")
    )
    above = {c: F.coalesce(f"{c}_", F.lit(1.0 if c == "a" else 0.0)) for c in "abw"}
    state = _climb(
        state, root["node"],
        {"a": F.col("a") * above["a"], "b": F.col("b") + F.col("a") * above["b"], "w": F.col("w") + F.col("a") * F.col("a") * above["w"]},
    )
    found = state.join(ends.withColumnRenamed("tip", "node"), "node", "left_semi").join(own.select("node", F.col("w").alias("weight")), "node", "left")
    return found.select(F.col("node").alias("tip"), F.coalesce("weight", none).alias("n"), F.col("b").alias("estimate"), F.sqrt("w").alias("est_error"))


def scaled_vcv(edges: DataFrame) -> DataFrame:
    """The covariance divided by det^(1/tips), which then has determinant one."""
    row = log_determinant(edges).first()
    return vcv(edges).withColumn("shared", F.col("shared") * F.lit(math.exp(-row["log_det"] / row["n_tips"])))


def tree_intercepts(frame: DataFrame, tip: str, residual: Column, edges: DataFrame) -> DataFrame:
    """Effects of the tips that residuals show: ``(tip, n, estimate, est_error, group_sd, residual_sd)``.

    Variances are moment estimates: the squares within tips, and those between them
    against what the tree's covariance lets expect. Rows without a residual take no part.
    Tips without rows get their effect from their relatives.
    """
    edges = pin(edges)
    r = F.col("r")
    sums = pin(
        frame.select(F.col(f"`{tip}`").cast("string").alias("tip"), residual.cast("double").alias("r")).where("r is not null")
        .groupBy("tip").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"))
    )
    t = sums.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.count(F.lit(1)).alias("tips"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
    ).first()
    if not t["tips"] or t["n"] <= t["tips"]:
        raise ValueError("no tip has more rows than one")
    branches = tip_factor(edges).join(sums.select("tip", "n"), "tip").groupBy("branch").agg(F.sum("n").alias("n"), F.max("length").alias("length"))
    v = branches.agg(F.sum(F.col("length") * F.col("n")).alias("own"), F.sum(F.col("length") * F.col("n") * F.col("n")).alias("shared")).first()
    within = (t["ss"] - t["between"]) / (t["n"] - t["tips"])
    mean = t["s"] / t["n"]
    spread = t["between"] - t["s"] * mean - (t["tips"] - 1) * within
    between = max(spread / (v["own"] - v["shared"] / t["n"]), 0.0)
    centred = sums.select("tip", "n", (F.col("s") - F.col("n") * F.lit(mean)).alias("s"))
    return tip_effects(centred, edges, within, between).withColumns({"group_sd": F.lit(math.sqrt(between)), "residual_sd": F.lit(math.sqrt(within))})
