"""Connected components of a graph held in a DataFrame, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) reach from node.

    Each round hooks every node to its smallest neighbour (a minimum, so it is combined before the
    shuffle even for a hub), renames both ends of every edge and drops the edges inside a tree. The
    graph at least halves per round; each round is a table in the shared folder. Null ends and loops
    are ignored. An empty graph gives an empty table.
    """
    graph = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = graph.select("a", "b").union(graph.select(F.col("b"), F.col("a")))
        hooks = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks")
        # One pointer jump: a node takes its hook's own hook.
        jumped = hooks.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        jumped = materialize(jumped, "jumps")
        if labels is None:
            labels = jumped.select("node", F.col("up").alias("component"))
        else:
            labels = materialize(labels.join(jumped.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        ends = graph.join(jumped.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(jumped.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        graph = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if graph.isEmpty():
            return labels
