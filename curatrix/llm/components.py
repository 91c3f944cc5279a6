"""Connected components of link tables, by least labels and pointer jumping; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from curatrix.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least reachable node of every node that has a link. Direction, order and repeats do not matter."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = stored(pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    label = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("root").alias("seen")), "y").groupBy(F.col("x").alias("node")).agg(F.min("seen").alias("seen"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        lower = label.join(near, "node", "left").join(jump, "root", "left").select("node", F.col("root").alias("was"), F.least("root", "seen", "up").alias("root"))
        seen = Observation()
        label = stored(lower.observe(seen, F.count_if(F.col("was") != F.col("root")).alias("moved")), "labels").select("node", "root")
        if not seen.get["moved"]:
            return label
