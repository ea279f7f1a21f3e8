"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import staged

#: A root's members are looked up by so many tasks.
SPREAD = 16


def by_root(members: DataFrame, table: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``members`` joined with ``table``, one row per ``root``; members of one root go to ``SPREAD`` tasks by their ``by``."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    part = F.pmod(F.xxhash64(by, F.lit("part")), F.lit(SPREAD)).cast("int")
    spread = table.withColumn("__part", parts)
    return members.withColumn("__part", part).join(spread, ["root", "__part"], how).drop("__part")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``u``, ``v``); ``root`` is the smallest node reachable.

    Each round a node takes the smallest label among its own, its neighbours' and
    that of the node its label names, so that distances double. Labels are written
    to the shared folder each round, which cuts the lineage.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = staged(edges.select("u", "v").union(turned).where("u <> v").distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        hooked = labels.join(around, labels["node"] == around["u"]).select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")
        )
        # Only roots that name a smaller one: few, once a component has found its own.
        names = hooked.select("root").distinct()
        further = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        names = names.join(further, "root").where("further <> root")
        moved = staged(by_root(hooked, names, "node", "left").select(
            "node", "before", F.coalesce("further", "root").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("before <> root").isEmpty():
            return labels
