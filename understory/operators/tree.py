"""Phylogeny as an edge table: root paths and shared branch lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from understory.session import pin

MAX_DOUBLINGS = 20
#: Tips of a block, tips of a branch up to which it shares blocks, and pairs of tips that are worth a task.
BLOCK_TIPS, SHARED_TIPS, TASK_PAIRS = 1024, 32, 1 << 22


def root_paths(edges: DataFrame) -> DataFrame:
    """Every ancestor of every node: ``(node, ancestor, hops, length)``.

    The known reach doubles each round, so a tree of depth d takes about
    log2(d) joins. ``length`` is the branch length between the two.
    """
    paths = pin(
        edges.select(
            F.col("child").alias("node"), F.col("parent").alias("ancestor"),
            F.lit(1).alias("hops"), F.col("length").cast("double").alias("length"),
        )
    )
    for doubling in range(MAX_DOUBLINGS):
        frontier = paths.where(F.col("hops") == F.lit(1 << doubling))
        onward = paths.select(
            F.col("node").alias("via"), F.col("ancestor").alias("beyond"),
            F.col("hops").alias("more_hops"), F.col("length").alias("more_length"),
        )
        found = pin(
            frontier.join(onward, F.col("ancestor") == F.col("via")).select(
                "node", F.col("beyond").alias("ancestor"),
                (F.col("hops") + F.col("more_hops")).alias("hops"),
                (F.col("length") + F.col("more_length")).alias("length"),
            )
        )
        if found.isEmpty():
            return paths
        if not found.where("node = ancestor").isEmpty():
            raise ValueError("the edge table has a cycle")
        paths = pin(paths.unionByName(found))
    raise ValueError(f"a path has more than {1 << MAX_DOUBLINGS} edges")


def node_depths(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Level and distance from the root of every node but the root."""
    paths = root_paths(edges) if paths is None else paths
    return paths.groupBy("node").agg(
        F.max("hops").alias("level"), F.max_by("length", "hops").alias("depth")
    )


def tips(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("tip")).join(
        edges.select(F.col("parent").alias("tip")), "tip", "left_anti"
    )


def tip_factor(edges: DataFrame) -> DataFrame:
    """``(tip, branch, length)``: every branch between a tip and the root, named by its lower node.

    The scale form of the covariance V = F diag(length) F': as many rows as tips times
    depth, where the pairs of ``vcv`` grow with the square of a clade.
    """
    edges = pin(edges)
    leaves = tips(edges)
    above = root_paths(edges).join(leaves, F.col("node") == F.col("tip"), "left_semi").select(F.col("node").alias("tip"), F.col("ancestor").alias("branch"))
    branches = edges.select(F.col("child").alias("branch"), F.col("length").cast("double").alias("length"))
    return above.unionByName(leaves.select("tip", F.col("tip").alias("branch"))).join(branches, "branch").select("tip", "branch", "length")


def times(factor: DataFrame, vector: DataFrame) -> DataFrame:
    """The covariance times a vector (``tip``, ``x``) as ``(tip, y)``: two aggregates, no pair of tips."""
    below = factor.join(vector, "tip").groupBy("branch").agg(F.sum("x").alias("x"))
    return factor.join(below, "branch").groupBy("tip").agg(F.sum(F.col("length") * F.col("x")).alias("y"))


def _pairs(sides: DataFrame) -> DataFrame:
    """``(tip_i, tip_j, shared)`` of tips below different branches of a fork. ``sides`` has ``fork``, ``shared``, ``branch``, ``tip``.

    Tips below a fork are cut into blocks, and pairs of blocks are dealt over tasks by the rows they
    make, so neither a fork nor a branch is one task. A branch has blocks of its own; small ones
    share blocks, where pairs of one branch are skipped.
    """
    sized = sides.join(sides.groupBy("fork", "branch").agg(F.count(F.lit(1)).alias("n")), ["fork", "branch"])
    # A node's name, after a sign that tells it from the blocks that small branches share.
    sized = sized.withColumn("of", F.when(F.col("n") > SHARED_TIPS, F.concat(F.lit("="), "branch")).otherwise(F.lit("")))
    number = sized.groupBy("fork", "of").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TIPS)).alias("blocks"))
    blocks = pin(
        sized.join(number, ["fork", "of"])
        .groupBy("fork", "shared", "of", F.pmod(F.xxhash64("tip"), "blocks").alias("part"))
        .agg(F.collect_list(F.struct("branch", "tip")).alias("tips"))
    )
    side = lambda s: blocks.select("fork", F.col("of").alias(f"of_{s}"), F.col("part").alias(f"part_{s}"), F.col("tips").alias(f"tips_{s}"))
    light = lambda s: blocks.select("fork", F.col("of").alias(f"of_{s}"), F.size("tips").cast("long").alias(f"n_{s}"))
    apart = (F.col("of_i") != F.col("of_j")) | (F.col("of_i") == "")
    rows = light("i").join(light("j"), "fork").where(apart).agg(F.sum(F.col("n_i") * F.col("n_j"))).scalar()
    rows = sides.sparkSession.range(1).select(rows.alias("n")).first()["n"] or 0  # one number
    slots = sides.sparkSession.sparkContext.defaultParallelism
    tasks = slots * max(1, -(-rows // (slots * TASK_PAIRS)))
    met = side("i").join(side("j"), "fork").where(apart).join(blocks.select("fork", "shared").distinct(), "fork")
    dealt = met.repartition(int(tasks), "fork", "of_i", "part_i", "of_j", "part_j")
    one = dealt.select("shared", F.explode("tips_i").alias("i"), "tips_j")
    return one.select("shared", "i", F.explode("tips_j").alias("j")).where("i.branch <> j.branch").select(
        F.col("i.tip").alias("tip_i"), F.col("j.tip").alias("tip_j"), "shared"
    )


def vcv(edges: DataFrame) -> DataFrame:
    """Shared branch length of tip pairs as sparse triplets ``(tip_i, tip_j, shared)``.

    A pair that meets only at the root shares nothing and has no row. Each pair
    is produced once, at the node where its lineages part, from the two child
    branches it lies on; no pair is built and then summed.
    """
    edges = pin(edges)
    paths = root_paths(edges)
    depths = node_depths(edges, paths)
    leaves = tips(edges)
    below = (
        paths.join(leaves, paths["node"] == leaves["tip"], "left_semi")
        .select(F.col("ancestor").alias("branch"), F.col("node").alias("tip"))
        .unionByName(leaves.select(F.col("tip").alias("branch"), "tip"))
    )
    inner = depths.where("depth > 0").select(F.col("node").alias("fork"), F.col("depth").alias("shared"))
    sides = edges.select(F.col("parent").alias("fork"), F.col("child").alias("branch")).join(inner, "fork").join(below, "branch")
    pairs = _pairs(sides)
    own = depths.join(leaves, depths["node"] == leaves["tip"]).select(
        F.col("tip").alias("tip_i"), F.col("tip").alias("tip_j"), F.col("depth").alias("shared")
    )
    return pairs.unionByName(own)
