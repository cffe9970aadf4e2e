"""Mutual-neighbour anchors between a reference (r) and a query (q) side, their scores, and the correction they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions.scalar import anchor_kernel, rescale_clamped
from cellweft.operators.hotkeys import compress, quantiles_interpolated
from cellweft.operators.knn import knn


def anchor_pairs(rq: DataFrame, qr: DataFrame, k: int = 5) -> DataFrame:
    """(r, q, score 1): q is among the k nearest of r and r among the k nearest of q.

    rq: (q = reference cell, d = query cell, rank, …); qr: the reverse. Both as knn() gives them.
    """
    a = rq.where(F.col("rank") <= k).select(F.col("q").alias("r"), F.col("d").alias("q"))
    b = qr.where(F.col("rank") <= k).select(F.col("d").alias("r"), F.col("q").alias("q"))
    return a.join(b, ["r", "q"]).withColumn("score", F.lit(1.0))


def filter_anchors(anchors: DataFrame, r_near: DataFrame, q_near: DataFrame, k: int = 200) -> DataFrame:
    """Anchors whose q is among the k nearest of r in the original space, or r among the k nearest of q."""
    a = r_near.where(F.col("rank") <= k).select(F.col("q").alias("r"), F.col("d").alias("q"))
    b = q_near.where(F.col("rank") <= k).select(F.col("d").alias("r"), F.col("q").alias("q"))
    return anchors.join(a.unionByName(b).distinct(), ["r", "q"], "left_semi")


def neighbour_edges(nn: dict[str, DataFrame], k: int) -> DataFrame:
    """(side_i, i, side_j, j): the union of the four neighbour tables in one index space, the first k of each row."""
    parts = []
    for name, (si, sj) in {"rr": ("r", "r"), "rq": ("r", "q"), "qr": ("q", "r"), "qq": ("q", "q")}.items():
        parts.append(nn[name].where(F.col("rank") <= k).select(F.lit(si).alias("side_i"), F.col("q").cast("string").alias("i"), F.lit(sj).alias("side_j"), F.col("d").cast("string").alias("j")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_anchors(anchors: DataFrame, nn: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """Anchors with the number of neighbours that r and q share, rescaled between its 1 % and 90 % quantiles and clamped to [0, 1]."""
    e = neighbour_edges(nn, k)
    er = e.where("side_i = 'r'").select(F.col("i").alias("rs"), "side_j", "j")
    eq = e.where("side_i = 'q'").select(F.col("i").alias("qs"), "side_j", "j")
    named = anchors.select("r", "q").distinct().select("r", "q", F.col("r").cast("string").alias("rs"), F.col("q").cast("string").alias("qs"))
    shared = named.join(er, "rs").join(eq, ["qs", "side_j", "j"]).groupBy("r", "q").agg(F.count(F.lit(1)).alias("n"))
    counted = anchors.select("r", "q").join(shared, ["r", "q"], "left").select("r", "q", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    q = quantiles_interpolated(compress(counted.withColumn("_all", F.lit(1)), ["_all"], "n"), ["_all"], [0.01, 0.9])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    bound = q.agg(at(0.01).alias("_lo"), at(0.9).alias("_hi"))  # one row
    return counted.join(F.broadcast(bound)).select("r", "q", rescale_clamped(F.col("n"), F.col("_lo"), F.col("_hi")).alias("score"))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def integration_vectors(anchors: DataFrame, ref: DataFrame, query: DataFrame) -> DataFrame:
    """(r, q, score, vec): query vector minus reference vector for each anchor."""
    return (
        anchors.join(ref.select(F.col("cell_id").alias("r"), F.col("vec").alias("rv")), "r").join(query.select(F.col("cell_id").alias("q"), F.col("vec").alias("qv")), "q")
        .select("r", "q", "score", _minus(F.col("qv"), F.col("rv")).alias("vec"))
    )


def anchor_weights(anchors: DataFrame, query: DataFrame, k: int = 300, sd: float = 1.0) -> DataFrame:
    """(cell_id, r, q, weight): the weight of each anchor for each query cell, summing to 1 for a cell.

    The anchors' query cells, one row per anchor, are ranked by correlation; the nearest is dropped, the next k kept,
    w = 1 - d / d_last. A weight found for a cell holds for all its anchors, the dropped one included. Cells whose
    weights are all 0 get no row and stay as they are. k is clamped to the anchors less one.
    """
    rows = anchors.select("r", "q", "score")
    per_cell = rows.groupBy("q").agg(F.count(F.lit(1)).alias("anchors"))
    total = per_cell.agg(F.coalesce(F.sum("anchors"), F.lit(0))).first()[0]  # one number
    k = min(k, total - 1)
    if k < 1:
        return query.select("cell_id", F.col("cell_id").alias("r"), F.col("cell_id").alias("q"), F.lit(0.0).alias("weight")).limit(0)
    # k + 1 anchor rows lie in at most k + 1 distinct cells
    cells = query.join(per_cell.select(F.col("q").alias("cell_id")), "cell_id", "left_semi")
    near = knn(cells, query, k + 1).join(per_cell.select(F.col("q").alias("d"), "anchors"), "d")
    order = Window.partitionBy("q").orderBy("rank")
    spread = near.withColumn("upto", F.sum("anchors").over(order)).withColumn("before", F.col("upto") - F.col("anchors")).where(F.col("before") < k + 1)
    last = F.max("dist").over(Window.partitionBy("q"))
    kept = spread.withColumn("last", last).where(F.least("upto", F.lit(k + 1)) >= F.greatest(F.lit(2), F.col("before") + 1))
    w = kept.select(F.col("q").alias("cell_id"), F.col("d").alias("q"), F.when(F.col("last") > 0, F.lit(1.0) - F.col("dist") / F.col("last")).otherwise(F.lit(0.0)).alias("w"))
    raw = w.join(rows, "q").select("cell_id", "r", "q", anchor_kernel(F.col("w") * F.col("score"), sd).alias("u"))
    whole = F.sum("u").over(Window.partitionBy("cell_id"))  # at most k + 1 anchors each
    return raw.withColumn("s", whole).where("s > 0").select("cell_id", "r", "q", (F.col("u") / F.col("s")).alias("weight"))


def apply_correction(query: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, vec): query vectors less the weighted sum of the integration vectors."""
    moved = weights.join(vectors.select("r", "q", "vec"), ["r", "q"]).select("cell_id", F.posexplode("vec").alias("i", "v"), "weight").groupBy("cell_id", "i").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    shift = moved.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("m")).select("cell_id", F.col("m.s").alias("shift"))  # one entry per feature
    return query.join(shift, "cell_id", "left").select("cell_id", F.when(F.col("shift").isNull(), F.col("vec")).otherwise(_minus(F.col("vec"), F.col("shift"))).alias("vec"))
