"""A plane for the eye: the neighbour graph laid out by its smooth vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.operators.knn import knn
from cellweft.session import stored


def layout(points: DataFrame, n_neighbours: int = 30, *, rounds: int = 30, dims: int = 2, metric: str = "correlation") -> tuple[DataFrame, DataFrame]:
    """((cell_id, e1, e2), neighbours): the leading non-trivial vectors of the random walk on the k-NN graph, by repeated smoothing.

    Vectors start from a hash of the cell, are averaged over the neighbours in each round, and kept free of the mean
    and of each other by sums over all cells; only those sums reach the driver. Scaled to unit variance.
    """
    nn = stored(knn(points, points, n_neighbours, metric=metric), "nn")
    e = nn.where("q <> d").select(F.col("q").alias("i"), F.col("d").alias("j"))
    edges = stored(e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "edges")
    cols = [f"e{k + 1}" for k in range(dims)]
    state = stored(points.select("cell_id", *[(F.pmod(F.xxhash64("cell_id", F.lit(k)), F.lit(20011)) / F.lit(10005.5) - 1).alias(c) for k, c in enumerate(cols)]), "layout")
    for r in range(rounds):
        near = edges.join(state, edges.j == state.cell_id).groupBy("i").agg(*[F.avg(c).alias(f"n_{c}") for c in cols])
        mixed = state.join(near, state.cell_id == near.i, "left").select("cell_id", *[(F.col(c) / 2 + F.coalesce(f"n_{c}", c) / 2).alias(c) for c in cols])
        mixed = stored(mixed, "layout")
        sums = mixed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in cols for b in cols]).first()
        n = max(1, sums["n"])
        mean = np.array([sums[c] or 0.0 for c in cols]) / n
        cov = np.array([[sums[f"{a}{b}"] or 0.0 for b in cols] for a in cols]) / n - np.outer(mean, mean)
        turn = np.linalg.inv(np.linalg.cholesky(cov + 1e-12 * np.eye(dims)))
        state = mixed.select("cell_id", *[sum((F.lit(float(turn[k, m])) * (F.col(c) - F.lit(float(mean[m]))) for m, c in enumerate(cols)), F.lit(0.0)).alias(cols[k]) for k in range(dims)])
    return stored(state, "layout"), nn
