"""Connected components of a graph held in DataFrames."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.sources.scratch import materialize, materialize_counted


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Give every node of ``nodes(id)`` one node of its component, the same for all, as ``root``.

    ``edges(a, b)`` are undirected. Each round ranks the nodes anew by a hash, hangs
    every node on its neighbour of lowest rank, and contracts the graph: edges inside
    a contracted node vanish and parallel ones merge. At least half of the nodes are
    expected to hang on another one whatever the shape of the graph, so the number
    of rounds grows with the logarithm of its size; ranks by id would creep along a
    chain of rising ids. A round writes one table, the edges that remain, and counts
    them while it does. In the end the rounds' steps are followed from the last to
    the first, among nodes that have edges, and looked up once for all nodes.
    """
    both_ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    remaining = edges.filter("a <> b").select(F.inline(both_ways)).distinct()
    steps: list[DataFrame] = []
    for number in range(max_rounds):
        remaining, left = materialize_counted(remaining, "edges", few=True)
        if not left:
            break
        hung = _hang(remaining, number)
        steps.append(hung)
        for end in ("a", "b"):
            remaining = remaining.join(hung.select(F.col("root").alias(end), F.col("top").alias(f"top_{end}")), end)
        remaining = remaining.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).filter("a <> b").distinct()
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if not steps:
        return nodes.select("id", F.col("id").alias("root"))
    top = reduce(_follow, reversed(steps))
    found = nodes.select("id").join(top.withColumnRenamed("root", "id"), "id", "left")
    return materialize(found.select("id", F.coalesce("top", "id").alias("root")), "roots", few=True)


def _follow(later: DataFrame, step: DataFrame) -> DataFrame:
    """One step and then the later ones."""
    then = later.select(F.col("root").alias("top"), F.col("top").alias("last"))
    return step.join(then, "top", "left").select("root", F.coalesce("last", "top").alias("top"))


def _hang(edges: DataFrame, number: int) -> DataFrame:
    """Each node as ``root`` with the node two steps down the ranks as ``top``."""

    def rank(name: str) -> Column:
        return F.xxhash64(F.col(name), F.lit(number))

    lowest = edges.groupBy("a").agg(F.min_by("b", rank("b")).alias("low"))
    below = lowest.select("a", F.when(rank("low") < rank("a"), F.col("low")).otherwise(F.col("a")).alias("low"))
    return below.select(F.col("a").alias("root"), F.col("low").alias("a")).join(below, "a").select(
        "root", F.col("low").alias("top")
    )
