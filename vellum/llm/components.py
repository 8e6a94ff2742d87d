"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import counted, small, stored


def priority(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def contractions(links: DataFrame) -> Iterator[DataFrame]:
    """node, label of the nodes that are left, round by round, until no link is.

    Every node hooks to its neighbour of least priority if that is less than its own; priorities are hashes, so
    chains of hooks are short whatever the numbering. A node's label is what two hooks lead to. Then links are drawn between
    labels: that is the image of the graph, whose components are the same. A node without a hook is less than its
    neighbours; either one of them hooks to it, or all hook to lesser ones and it will hook to one of these next. So the nodes that are left
    shrink by a constant factor in two rounds. Priorities stay the same, by which the middle of a star is its least node
    from the second round on; they are drawn anew only if no link went, as where two hashes are equal.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges, n = counted(edges, "links")
    turn = 0
    while n:
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min_by("b", priority(F.col("b"), turn)).alias("near"))
        hooked = priority(F.col("near"), turn) < priority(F.col("a"), turn)
        hooks = near.select(F.col("a").alias("node"), F.when(hooked, F.col("near")).otherwise(F.col("a")).alias("label"))
        further = hooks.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = small(*counted(hooks.join(further, "label").select("node", F.col("further").alias("label")), "labels"))
        yield labels
        moved = edges
        for side in ("a", "b"):
            moved = moved.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side)
        ends = F.least("a_label", "b_label"), F.greatest("a_label", "b_label")
        moved = moved.where("a_label <> b_label").select(ends[0].alias("a"), ends[1].alias("b")).distinct()
        before = n
        edges, n = counted(moved, "links")
        turn += n == before


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node of links (a, b), the least node it is connected with.

    Rounds grow with the logarithm of the number of nodes, also on paths numbered at random. A node is in the tables of a round
    only as long as it stands for others; what reaches the driver are numbers of links. Links are distinct, so a hub's links
    meet it in joins whose other side has one row for each node: skewed partitions are split. A null end links nothing.
    """
    rounds = list(contractions(links.where("a is not null and b is not null")))
    if not rounds:
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).where("node is not null").distinct()
        return ends.select("node", F.col("node").alias("component"))
    found = rounds[-1]
    for labels in reversed(rounds[:-1]):  # where a round's labels lead in later ones
        later = found.select(F.col("node").alias("label"), F.col("label").alias("further"))
        found = labels.join(later, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    found = stored(found, "roots")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    linked = found.join(least, "label").select("node", "component")
    loops = links.where("a = b").select(F.col("a").alias("node")).distinct().join(linked, "node", "left_anti")
    return linked.union(loops.select("node", F.col("node").alias("component")))
