"""A large group of near copies has about one link a member, not one for each pair of blocks."""

import numpy as np
from pyspark.sql import functions as F

from understory.llm import jaccard
from understory.llm.common import components


def test_blocks_link_their_firsts_only(spark):
    n = 1500  # six blocks
    sketch = np.arange(jaccard.POSITIONS, dtype="<u4").tobytes()
    rows = spark.range(n).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("_set"))
    members = rows.withColumn("_sketch", F.lit(bytearray(sketch)))
    found = rows.select(F.lit(1).cast("long").alias("_path"), "_set", F.lit(n).cast("long").alias("_size"))
    links = jaccard.candidates(members, found, 0.5)
    assert links.count() <= n + 6 * 6
    groups = components(links)
    assert groups.count() == n
    assert groups.select("root").distinct().count() == 1
