"""Connected components of a distributed list of links, without a task or driver that holds a component."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessera.scratch import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long): root is the smallest node it is connected to.

    Links may repeat, run either way or join a node to itself; null ends are ignored. Nodes without links are not listed.

    Each round hooks every node to its smallest neighbour when that is smaller (a partial aggregate, so a hub costs one
    row per task), flattens the resulting trees by pointer doubling, and contracts the links to roots. Nodes that are
    not local minima vanish in a round, so their number at least halves; doubling takes the logarithm of the depth. All
    joins meet a table with one row per node, so adaptive execution may split the other side at a hub.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    answer = materialise(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not links.isEmpty():
        hooks = materialise(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            longer = materialise(
                hooks.join(nxt, "root", "left").select(
                    "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
                )
            )
            moved = not longer.where("moved").isEmpty()
            discard(hooks)
            hooks = longer.drop("moved")
            if not moved:
                break

        def follow(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            to = hooks.select(F.col("node").alias(column), F.col("root").alias("_to"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        old_links, old_answer = links, answer
        links = materialise(
            follow(follow(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        answer = materialise(follow(answer, "root").select("node", "root"))
        for old in (old_links, old_answer, hooks):
            discard(old)
    return answer
