"""Connected components by minimum labels with pointer jumping, all in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, comp)`` for every id in an edge; comp is the smallest id reachable.

    Each round takes the least label around every vertex and then jumps to that label's own label, so chains
    shorten geometrically; rounds are cut by written tables.  No edges give an empty table.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    label = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (
            both.join(label.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("comp").alias("near"))
        )
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = saved(
            label.join(jump, "comp", "left")
            .join(near, "id", "left")
            .select(
                "id",
                F.least("comp", F.coalesce("far", "comp"), F.coalesce("near", "comp")).alias("comp"),
                F.col("comp").alias("old"),
            ),
            "labels",
        )
        label = new.select("id", "comp")
        if new.filter("comp <> old").isEmpty():
            return label
