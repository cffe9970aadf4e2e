"""Tables ready to plot: positions or an embedding with expression bins, clusters or a marked cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalar import bins


def _shifted(points: DataFrame) -> DataFrame:
    low = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))  # one row
    return points.join(F.broadcast(low)).select("cell_id", (F.col("x") - F.col("_x")).alias("e1"), (F.col("y") - F.col("_y")).alias("e2"))


def expression(embedding: DataFrame, long: DataFrame, names: Sequence, n_bins: int = 100) -> DataFrame:
    """(cell_id, e1, e2, value1, bin1[, value2, bin2]) for one or two features; cells without a value have 0. A view with nothing above 0 has signal false."""
    if not 1 <= len(names) <= 2:
        raise ValueError("one or two features can be shown")
    known = {r[0] for r in long.where(F.col("feature").isin(list(names))).select("feature").distinct().collect()}
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"no feature named {missing[0]!r}")
    wide = long.where(F.col("feature").isin(list(names))).groupBy("cell_id").agg(*[F.sum(F.when(F.col("feature") == n, F.col("value"))).alias(f"value{i + 1}") for i, n in enumerate(names)])
    out = embedding.select("cell_id", "e1", "e2").join(wide, "cell_id", "left").na.fill(0.0, [f"value{i + 1}" for i in range(len(names))])
    ends = out.agg(*[f(f"value{i + 1}").alias(f"_{k}{i + 1}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))])  # one row
    out = out.join(F.broadcast(ends))
    for i in range(1, len(names) + 1):
        out = out.withColumn(f"bin{i}", bins(F.col(f"value{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), n_bins))
    signal = F.greatest(*[F.col(f"_hi{i + 1}") for i in range(len(names))], F.lit(0.0)) > 0
    return out.withColumn("signal", signal).drop(*[f"_{k}{i + 1}" for i in range(len(names)) for k in ("lo", "hi")])


def expression_spatial(points: DataFrame, long: DataFrame, names: Sequence, n_bins: int = 100) -> DataFrame:
    """expression() on positions moved to start at 0, the y axis turned over."""
    return expression(_shifted(points), long, names, n_bins).withColumn("e2", -F.col("e2"))


def clusters(embedding: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(cell_id, e1, e2, cluster); cells without a label, or all if there are none, are -1."""
    if labels is None:
        return embedding.select("cell_id", "e1", "e2", F.lit("-1").alias("cluster"))
    c = labels.select("cell_id", F.col("cluster").cast("string").alias("cluster"))
    return embedding.select("cell_id", "e1", "e2").join(c, "cell_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit("-1")))


def clusters_spatial(points: DataFrame, labels: DataFrame | None) -> DataFrame:
    """clusters() on positions moved to start at 0; y as it is."""
    return clusters(_shifted(points), labels)


def marked(embedding: DataFrame, cell_id) -> DataFrame:
    """(cell_id, e1, e2, marked, layer): one cell to be drawn last."""
    hit = F.col("cell_id") == F.lit(cell_id)
    return embedding.select("cell_id", "e1", "e2", hit.alias("marked"), hit.cast("int").alias("layer"))


def marked_spatial(points: DataFrame, cell_id) -> DataFrame:
    return marked(_shifted(points), cell_id).withColumn("e2", -F.col("e2"))


def app_view(embedding: DataFrame, mode: str, *, long: DataFrame | None = None, feature=None, transfer: DataFrame | None = None, cell_id=None, pilot: bool = False) -> DataFrame:
    """(cell_id, e1, e2, value, drawn_last, signal) for the interactive views: a protein, a gene (logged), or what a selected cell sends."""
    from cellweft.operators.transfer import one_feature, selected_cells

    spark = embedding.sparkSession
    if mode == "protein":
        value = long.where(F.col("feature") == feature).select("cell_id", "value")
    elif mode == "gene" and transfer is not None:
        value = one_feature(transfer, long, feature).select("cell_id", F.log1p(F.lit(1000.0) * F.col("value")).alias("value"))
    elif mode == "gene" and pilot:
        total = long.groupBy("cell_id").agg(F.sum("value").alias("t"))
        value = long.where(F.col("feature") == feature).join(total, "cell_id").select("cell_id", F.log2(1 + F.lit(10000.0) * F.col("value") / F.col("t")).alias("value"))
    elif mode == "gene":
        value = long.where(F.col("feature") == feature).select("cell_id", F.log1p(F.lit(5000.0) * F.col("value")).alias("value"))
    elif mode == "cell" and transfer is not None:
        value = selected_cells(transfer, spark.createDataFrame([(cell_id,)], f"cell_id {embedding.schema['cell_id'].dataType.simpleString()}"))
    elif mode == "cell":
        value = embedding.select("cell_id", (F.col("cell_id") == F.lit(cell_id)).cast("double").alias("value"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = embedding.select("cell_id", "e1", "e2").join(value, "cell_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    most = out.agg((F.max("value") > 0).alias("signal"))  # one row
    return out.join(F.broadcast(most)).withColumn("drawn_last", F.col("value") != 0)
