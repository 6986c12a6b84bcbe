"""Connected components of an edge list, as joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import discard, materialize


#: Edges in one file of a round's table, so that small rounds don't leave many small files.
EDGES_A_FILE = 500_000


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each pair with the least node among u and its partners v. Minimum before join: a hub shuffles one row per task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Rows (node, root) for every node with an edge to another; root is the least node of its component.

    Alternates large-star and small-star contraction until the edges form stars. Only counts reach the driver, and
    each round is a table in the shared folder. Null ends and self-loops are ignored; repeated edges count once; no
    edges give no rows.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _nearest(large)
        step = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after, new = materialize(step if state is None else step.coalesce(1 + state[0] // EDGES_A_FILE), "edges")
        discard(spark, path)
        now, path = after, new
        # Equal edge sets before and after a round mean that all are stars. Two hash sums stand for the set.
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first()
        if state == was or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
