"""Connected components of a graph held in a DataFrame.

Each round every node that has a smaller neighbour takes the smallest as its
parent (partial aggregation: a hub costs one row per task), parents are jumped
until all are roots (each jump halves a chain), and the edges are renamed to
their ends' roots. A tree of hooks has no cycle since parents are smaller; the
rounds end when no edge is left between different labels, after a number that
grows with the logarithm of the largest component. A node is hooked in one round
only, so it gets one label. Joins are on node labels and can be split where skewed.
Each round is written to the shared folder, so that lost executors cost one round at
most, and removed when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.common import release, written


def _renamed(df: DataFrame, col: str, parents: DataFrame) -> DataFrame:
    """df with the parents' labels in place of col, where they have one."""
    p = parents.select(F.col("node").alias("_of"), F.col("parent").alias("_to"))
    others = [c for c in df.columns if c != col]
    return df.join(p, df[col] == p["_of"], "left").select(*others, F.coalesce("_to", col).alias(col))


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges between different labels, larger end first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label for every node of edges(a, b) that isn't its component's label.

    The label is the component's smallest node. Self-loops and repeats are fine.
    """
    labels: DataFrame | None = None
    left = written(_between(edges), f"{name}-edges")
    while not left.isEmpty():
        parents = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        hooks = written(parents, f"{name}-hooks")
        while not hooks.join(hooks.select(F.col("node").alias("_of")), F.col("parent") == F.col("_of"), "left_semi").isEmpty():
            hooks, old = written(_renamed(hooks, "parent", hooks), f"{name}-hooks"), hooks
            release(old)
        if labels is None:
            labels = written(hooks.select("node", F.col("parent").alias("label")), f"{name}-labels")
        else:
            # nodes that were roots so far are new in hooks
            moved = _renamed(labels.select("node", F.col("label").alias("x")), "x", hooks).select("node", F.col("x").alias("label"))
            labels, old = written(moved.unionByName(hooks.select("node", F.col("parent").alias("label"))), f"{name}-labels"), labels
            release(old)
        left, old = written(_between(_renamed(_renamed(left, "a", hooks), "b", hooks)), f"{name}-edges"), left
        release(old, hooks)
    release(left)
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    return labels
