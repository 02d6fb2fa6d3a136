"""Connected components of a graph that stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrace.session import staged


def _flat(parents: DataFrame) -> DataFrame:
    """(node, parent) with every chain followed to its end, by pointer doubling."""
    current = staged(parents, "parents")
    while True:
        above = current.select(F.col("node").alias("_mid"), F.col("parent").alias("_top"))
        jumped = staged(
            current.join(above, F.col("parent") == F.col("_mid"), "left").select(
                "node",
                F.coalesce("_top", "parent").alias("parent"),
                F.col("_top").isNotNull().alias("_moved"),
            ),
            "jumped",
        )
        moved = not jumped.filter("_moved").isEmpty()
        current = jumped.drop("_moved")
        if not moved:
            return current


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Each round hooks a node to its least smaller neighbour, follows the chains and
    draws the edges anew between their ends. A round leaves only nodes without a
    smaller neighbour, so rounds are logarithmic in practice. Every step is a
    partial aggregate or an equi join; results are written, so lost executors
    repeat one step only. Loops (a = b) and repeated edges are allowed; an empty
    table gives an empty one.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = staged(ends.filter("a < b").distinct(), "edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = staged(nodes.withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        parents = _flat(
            left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        )
        up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
        roots = staged(
            roots.join(up, F.col("root") == F.col("_node"), "left").select(
                "node", F.coalesce("_parent", "root").alias("root")
            ),
            "roots",
        )
        mapped = left
        for end in ("a", "b"):
            mapped = mapped.join(up, F.col(end) == F.col("_node"), "left").select(
                *[F.coalesce("_parent", c).alias(c) if c == end else F.col(c) for c in ("a", "b")]
            )
        left = staged(
            mapped.filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "edges",
        )
    return roots
