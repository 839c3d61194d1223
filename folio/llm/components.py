"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.joins import join_by_weight
from folio.sources.staging import free, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has a link; ``comp`` is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label, so
    that long chains shorten by powers of two.  Labels stay distributed; the driver sees counts.  A hub
    with very many links, and a component of very many nodes, are no burden to one task.
    """
    edges = staged(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).where("x <> y").distinct(), "edges")
    n_edges = edges.count()
    labels = staged(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("comp"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("x", "node"), "labels")
    n_nodes = labels.count()
    while True:
        near = join_by_weight(edges, labels.select(F.col("node").alias("y"), "comp", "degree"), ["y"], "degree", n_edges).groupBy("x").agg(F.min("comp").alias("near"))
        least = staged(labels.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", "degree", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "least")
        # The label of a label: every label is a node.
        jump = least.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp")
        fresh = staged(join_by_weight(least, jump, ["comp"], "nodes", n_nodes).select("node", "degree", "was", F.least("comp", "next").alias("comp")), "labels")
        changed = fresh.where("was <> comp").limit(1).count()
        free(labels, least)
        labels = fresh.drop("was")
        labels._folio_folder = fresh._folio_folder
        if not changed:
            free(edges)
            return labels.select("node", "comp")
