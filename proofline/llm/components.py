"""Connected components of an edge table, by contraction, without gathering them anywhere.

Each round gives every node the smallest node it can see, follows these pointers, and replaces
edges by the edges between what is left. Rounds are written to the shared folder. A round at
least halves the nodes that still have edges, so the rounds number the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the ``a``, ``b`` edges; root is one node of the component, the same for all of it."""
    spark = edges.sparkSession
    with store.Scope(spark) as scope:
        edges = store.table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        labels = None
        while True:
            both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
            for _ in range(2):  # smaller and smaller, so no cycle can arise
                up = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
                low = store.table(low.join(up, "root").select("node", F.col("next").alias("root")), "low")
            to = lambda x: low.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
            fewer = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            edges = store.table(fewer.filter("a <> b").distinct(), "edges")
            moved = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = low if labels is None else store.table(labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            if edges.isEmpty():
                return scope.keep(labels, "labels")
