"""Connected components of an edge table, with DataFrame operations only.

Alternating star contraction: a large star hangs every larger neighbour of a node
on the least node around it, a small star does the same with the smaller
neighbours.  The rounds needed grow with the logarithm of the longest path.  Each
round writes its edges to the shared folder, so lineage stays short.  The least
neighbour is found by an aggregate that combines inside the map tasks, and is
written before the join, so that both join sides are plain exchanges and adaptive
execution can split the partition of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqspark.llm.shared import drop_kept, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")),
    ).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(src, dst)``; component is the least node reachable.

    Repeated edges, both directions and self links are allowed; null ends are ignored.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    linked = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL")
        .select(high.alias("high"), low.alias("low")).distinct()
    )
    now = keep(linked.where("high <> low"), "edges")
    state = _state(now)
    while state[0]:
        around = now.select(F.col("low").alias("node"), F.col("high").alias("other")).union(
            now.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = keep(around.groupBy("node").agg(F.min("other").alias("other")).select(
            F.col("node").alias("low"), F.least("node", "other").alias("least")), "least")
        large = keep(now.join(least, "low").select("high", F.col("least").alias("low")).distinct(), "large")
        root = keep(large.groupBy("high").agg(F.min("low").alias("least")), "root")
        small = (
            large.join(root, "high").where("low <> least")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .union(root.select("high", F.col("least").alias("low"))).distinct()
        )
        after = keep(small, "edges")
        seen, state = state, _state(after)
        for gone in (now, least, large, root):
            drop_kept(gone)
        now = after
        if state == seen:
            break
    members = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    centres = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return members.union(centres)
