"""Connected components of a table of links, as repeated contraction.

Each round every node with a smaller neighbour points to its smallest one, pointers are
followed to their roots, and the links are rewritten between roots, where most
of them vanish.  Groups only meet in minima (combined map-side) and in joins whose
large sides AQE can split; every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import release, staged


def _follow(table: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """column replaced by what it points to, if it points anywhere."""
    to = pointers.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
    return table.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link.

    Links may come in any direction and number; loops and nulls are no links.
    """
    links = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links")
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = staged(ends.select("node", F.col("node").alias("component")), "labels")
    while not links.isEmpty():
        pointers = staged(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")), "pointers")
        while True:
            further = staged(_follow(pointers.select("node", "to", F.col("to").alias("was")), "to", pointers), "pointers")
            moved = not further.where(F.col("to") != F.col("was")).isEmpty()
            release(pointers)
            pointers = further
            if not moved:
                break
        fresh = staged(_follow(label, "component", pointers), "labels")
        between = _follow(_follow(links, "u", pointers), "v", pointers).where("u != v")
        left = staged(between.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        release(label, links, pointers)
        label, links = fresh, left
    release(links)
    return label
