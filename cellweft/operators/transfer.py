"""Features and labels carried from reference cells to imaging cells along a sparse weight table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions.scalar import distance_weight
from cellweft.operators.knn import knn

NOBODY = "-1"


def transfer_matrix(cite: DataFrame, codex: DataFrame, k: int | None = None, c: float = 0.1) -> DataFrame:
    """(codex_id, cite_id, weight): each reference cell's k nearest imaging cells with exp(-d / c), summing to 1 per reference cell.

    k is 0.2 % of the imaging cells by default, at least 1.
    """
    k = max(1, codex.count() // 500 if k is None else k)
    w = knn(codex, cite, k).where("dist IS NOT NULL").select(F.col("d").alias("codex_id"), F.col("q").alias("cite_id"), distance_weight(F.col("dist"), c).alias("w"))
    return w.select("codex_id", "cite_id", (F.col("w") / F.sum("w").over(Window.partitionBy("cite_id"))).alias("weight"))


def transfer_features(transfer: DataFrame, long: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(cell_id, feature, value): weighted sums of the reference cells' shares of their totals, zeros left out."""
    total = long.groupBy("cell_id").agg(F.sum("value").alias("t"))
    if features is not None:
        long = long.join(features, "feature", "left_semi")
    share = long.where("value <> 0").join(total, "cell_id").where("t <> 0").select(F.col("cell_id").alias("cite_id"), "feature", (F.col("value") / F.col("t")).alias("share"))
    return transfer.join(share, "cite_id").groupBy(F.col("codex_id").alias("cell_id"), "feature").agg(F.sum(F.col("weight") * F.col("share")).alias("value"))


def soft_membership(transfer: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cell_id, cluster, weight): how much of each cluster reaches each imaging cell."""
    c = clusters.select(F.col("cell_id").alias("cite_id"), F.col("cluster").cast("string").alias("cluster"))
    return transfer.join(c, "cite_id").groupBy(F.col("codex_id").alias("cell_id"), "cluster").agg(F.sum("weight").alias("weight"))


def transfer_clusters(transfer: DataFrame, clusters: DataFrame, codex: DataFrame) -> DataFrame:
    """(cell_id, cluster): the cluster of most weight, ties to the smaller name; "-1" for cells that nothing reaches."""
    best = (
        soft_membership(transfer, clusters).withColumn("rn", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.round("weight", 12).desc(), "cluster")))
        .where("rn = 1").select("cell_id", F.when(F.col("weight") > 0, F.col("cluster")).otherwise(F.lit(NOBODY)).alias("cluster"))
    )
    return codex.select("cell_id").join(best, "cell_id", "left").select("cell_id", F.coalesce("cluster", F.lit(NOBODY)).alias("cluster"))


def neighbour_vote(cite: DataFrame, codex: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(cell_id, cluster): the label with the largest sum of 1 / distance among the k nearest reference cells; an exact hit counts as 1e-9 away."""
    near = knn(cite, codex, k, metric="euclidean").join(clusters.select(F.col("cell_id").alias("d"), F.col("cluster").cast("string").alias("cluster")), "d")
    votes = near.groupBy("q", "cluster").agg(F.sum(1 / F.greatest("dist", F.lit(1e-9))).alias("v"))
    return votes.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.round("v", 9).desc(), "cluster"))).where("rn = 1").select(F.col("q").alias("cell_id"), "cluster")


def one_feature(transfer: DataFrame, long: DataFrame, feature) -> DataFrame:
    """(cell_id, value) of one feature of the reference, filtered before anything is joined."""
    f = long.where(F.col("feature") == feature).select(F.col("cell_id").alias("cite_id"), "value")
    return transfer.join(f, "cite_id").groupBy(F.col("codex_id").alias("cell_id")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def selected_cells(transfer: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, value): the weight that a selection of reference cells (cell_id) sends to each imaging cell."""
    return transfer.join(cells.select(F.col("cell_id").alias("cite_id")), "cite_id", "left_semi").groupBy(F.col("codex_id").alias("cell_id")).agg(F.sum("weight").alias("value"))
