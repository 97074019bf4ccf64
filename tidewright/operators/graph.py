"""Connected components by least labels, each round a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(id)`` and undirected ``edges(a, b)`` to (id, comp), comp the least id reachable.

    A round lowers each label to the least label around it and then to that label's own label, so the number of rounds
    grows with the logarithm of a chain's length.  A vertex without edges is its own component; edges of unknown
    vertices, loops and nulls have no effect.
    """
    known = vertices.select("id").filter("id is not null").distinct()
    there = lambda c: known.select(F.col("id").alias(c))
    links = edges.filter("a <> b").select("a", "b").join(there("a"), "a", "left_semi").join(there("b"), "b", "left_semi")
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = staged(known.withColumn("comp", F.col("id")), "labels")
    while True:
        around = both.join(label.toDF("b", "seen"), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        lower = label.join(around, "id", "left").select("id", F.least("comp", "seen").alias("comp"), F.col("comp").alias("was"))
        jump = label.toDF("comp", "far")
        new = staged(lower.join(jump, "comp", "left").select("id", F.least("comp", "far").alias("comp"), "was"), "labels")
        label = new.select("id", "comp")
        if new.filter("comp <> was").isEmpty():
            return label
