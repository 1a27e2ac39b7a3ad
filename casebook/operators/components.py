"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``; the component is its smallest node.

    Every node has a parent, at first the smallest among itself and its neighbours. A round takes, for every node, the
    smallest grandparent among its neighbours, and hooks both the node and its *parent* below that, then lets every node
    jump to its grandparent. As whole trees are hooked, not single nodes, the number of rounds follows the logarithm of
    the component's size whatever the order of its ids, also on long paths; there is no fixed limit. It ends when no
    grandparent changes: parents never rise, so this is reached.

    Minima are aggregated partly before each shuffle, so a node with very many neighbours does not gather them in one
    task; rounds are written to the shared folder, which cuts the lineage. Null ends are ignored; self-loops give
    singletons; repeated edges do no harm; an empty table gives an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a union would make the edges twice
    both = written(ends.select(F.explode(ways).alias("e")).select("e.*").distinct(), "edges")
    parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p")
    trees = written(_with_grandparents(written(parents, "parents")), "trees")
    while True:
        lowest = both.join(trees.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        seen = trees.join(lowest, "node").select("node", "p", "g", "m")
        hooks = seen.select(F.explode(F.array(F.struct("node", F.least("p", "g", "m").alias("p")), F.struct(F.col("p").alias("node"), F.col("m").alias("p")))).alias("h"))
        hooked = written(hooks.select("h.node", "h.p").groupBy("node").agg(F.min("p").alias("p")), "parents")
        after = written(_with_grandparents(hooked), "trees")
        changed = not after.join(trees.select("node", F.col("g").alias("before")), "node").where("g <> before").isEmpty()
        trees = after
        if not changed:
            return trees.select("node", F.col("p").alias("component"))


def _with_grandparents(parents: DataFrame) -> DataFrame:
    return parents.join(parents.select(F.col("node").alias("p"), F.col("p").alias("g")), "p").select("node", "p", "g")
