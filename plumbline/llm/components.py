"""Connected components of a graph of links, by contraction.

Each round every node takes its smallest neighbour as parent, chains of parents are
shortened until they end in a root, and links are rewritten between roots; links inside
a component vanish. Every table of a round is checkpointed, so the lineage stays short.
Nodes with many links only enter counts that Spark merges before a shuffle, and joins
whose other side has one row for a node, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed


def _shortened(parents: DataFrame) -> DataFrame:
    """node, root: parents followed to their end; pointer doubling, so in log of the longest chain."""
    while True:
        above = parents.select(F.col("node").alias("parent_"), F.col("root").alias("above"))
        doubled = checkpointed(
            parents.join(above, parents["root"] == above["parent_"], "left").select(
                "node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")
            )
        )
        parents = doubled.select("node", "root")
        if doubled.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (columns a, b; any orderable type); root is the component's smallest node."""
    links = checkpointed(
        links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    found = None
    while not links.isEmpty():
        # A larger node points to its smallest neighbour; a node without a smaller one is a root of this round.
        ends = F.array(*(F.struct(F.col(node).alias("node"), F.col("a").alias("root")) for node in "ab"))
        roots = _shortened(links.select(F.inline(ends)).groupBy("node").agg(F.min("root").alias("root")))
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(a, "a").join(b, "b").where("ra != rb")
        links = checkpointed(
            links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = checkpointed(
                found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
