"""Connected components of a link table by contraction, on DataFrames.

Each round maps every node to the smallest node among itself and its neighbours, follows those pointers to their
roots by doubling, and replaces the links by the distinct links between roots.  Stars, the usual shape here, vanish
in one round; a path of n nodes takes O(log n) joins.  Every step is a stored table, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable."""
    both = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links, rounds = shared.stored(both, "links"), []
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("a").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        root = shared.stored(ends.groupBy("node").agg(F.min("to").alias("to")), "roots")
        while True:
            step = root.select(F.col("node").alias("to"), F.col("to").alias("further"))
            root = shared.stored(root.join(step, "to", "left").select("node", F.coalesce("further", "to").alias("to"), (F.col("further") < F.col("to")).alias("moved")), "roots")
            moved = not root.where("moved").isEmpty()
            root = root.select("node", "to")
            if not moved:
                break
        rounds.append(root)
        at = lambda c: root.select(F.col("node").alias(c), F.col("to").alias(c + "_root"))
        links = links.join(at("a"), "a").join(at("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        links = shared.stored(links.where("a < b").distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].select("node", F.col("to").alias("component"))
    for root in rounds[1:]:
        step = root.select(F.col("node").alias("component"), F.col("to").alias("further"))
        out = out.join(step, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return shared.stored(out, "components")
