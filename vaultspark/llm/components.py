"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) for every node of `edges(a long, b long)`, and its table; root is the smallest node reachable.

    Nodes with null, and edges from a node to itself, take no part. Every round is a few
    aggregations and equi-joins on the edge table, whose size never grows; each round's edges are
    written to the shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    start = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now, path = materialize(start, "edges")
    state = None
    for _ in range(max_rounds):
        if state is None:
            state = _state(now)
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _smallest(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after, next_path = materialize(small, "edges")
        now, old, path = after, path, next_path
        release(spark, old)
        changed = _state(now)
        if changed == state:
            break
        state = changed
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), path


def _state(edges: DataFrame) -> tuple:
    """Size and two order-free sums of the edge table: equal before and after a round that changes nothing."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0))).first())
