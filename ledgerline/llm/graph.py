"""Connected components of a link table, by contraction in DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, materialize, reading


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (columns a, b of one orderable type); root is the same for all nodes that links
    connect. Self-links only name a node.

    In a round each node points to its smallest neighbour or itself, pointers are followed four steps, and links between
    what they reach are all that is left for the next round. A star of any size is one round's partial aggregation, a
    path of n nodes takes log n rounds. Groups are never gathered in a row; the joins that follow pointers meet one row a target,
    so the many pointers of a large group are split by Spark's skew join. Only row counts come to the driver.
    """
    left = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    spent: list[DataFrame] = []
    while True:
        both = left.union(left.select("b", "a"))
        first = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
        steps.append(materialize(_follow(_follow(first, first), _follow(first, first))))
        discard(first)
        up = steps[-1]
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("c")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("d")), "b")
        rest = ends.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        spent.append(left)
        left = materialize(rest)
        if left.isEmpty():
            break
    discard(*spent, left)
    roots = steps[0]
    for step in steps[1:]:
        roots = _follow(roots, step)
    return reading(roots.select("node", F.col("up").alias("root")), *steps)


def _follow(pointers: DataFrame, step: DataFrame) -> DataFrame:
    """Each pointer moved on by step, where step has its target."""
    on = step.select(F.col("node").alias("__at"), F.col("up").alias("__to"))
    return pointers.join(on, pointers["up"] == on["__at"], "left").select("node", F.coalesce("__to", "up").alias("up"))
