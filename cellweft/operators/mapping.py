"""Canonical correlation between two sides, and the correction of one side onto the other in chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalar import l2_normalise, standardise
from cellweft.operators.anchors import anchor_pairs, anchor_weights, apply_correction, filter_anchors, integration_vectors, score_anchors
from cellweft.operators.knn import knn
from cellweft.session import stored


def gram(df: DataFrame, dim: int) -> np.ndarray:
    """The sum of v v' over all rows: only dim x dim numbers leave the executors."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                total += v.T @ v
        i, j = np.indices((dim, dim))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    out = np.zeros((dim, dim))
    for r in df.select("vec").mapInArrow(add, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def _roots(g: np.ndarray, power: float) -> np.ndarray:
    w, u = np.linalg.eigh((g + g.T) / 2)
    good = w > w.max(initial=0) * 1e-10
    return (u[:, good] * w[good] ** power) @ u[:, good].T


def cca(first: DataFrame, second: DataFrame, dim: int, num_cc: int | None = None, *, standardize: bool = True, l2: bool = False) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((cell_id, vec) of the first side, of the second, d): the leading singular vectors of the cells x cells product of both sides, without forming it.

    A canonical vector is turned so that the entry of the first cell (the least id of the first side) is not negative.
    """
    num_cc = dim - 1 if num_cc is None else num_cc
    ready = lambda df: stored(df.select("cell_id", (standardise(F.col("vec")) if standardize else F.col("vec")).alias("vec")).where(~F.exists("vec", lambda x: F.isnan(x))), "cca")
    a, b = ready(first), ready(second)
    ga, gb = gram(a, dim), gram(b, dim)
    p, d, rt = np.linalg.svd(_roots(ga, 0.5) @ _roots(gb, 0.5))
    num_cc = min(num_cc, int((d > d.max(initial=0) * 1e-10).sum()))
    wa, wb = _roots(ga, -0.5) @ p[:, :num_cc], _roots(gb, -0.5) @ rt.T[:, :num_cc]
    head = a.orderBy("cell_id").limit(1).collect()
    if head:
        sign = np.where(np.array(head[0]["vec"]) @ wa < 0, -1.0, 1.0)
        wa, wb = wa * sign, wb * sign

    def project(df: DataFrame, w: np.ndarray) -> DataFrame:
        cols = [F.array(*[F.lit(float(x)) for x in w[:, j]]) for j in range(w.shape[1])]
        dot = lambda c: F.aggregate(F.zip_with(F.col("vec"), c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        v = F.array(*[dot(c) for c in cols])
        return df.select("cell_id", (l2_normalise(v) if l2 else v).alias("vec"))

    return project(a, wa), project(b, wb), d[:num_cc]


def correct(ref: DataFrame, query: DataFrame, latent: DataFrame, dim: int, *, num_cc: int | None = None, k_anchor: int = 20, k_filter: int = 100, k_score: int = 80, k_weight: int = 100) -> DataFrame:
    """(cell_id, vec): the query cells moved onto the reference by anchors found in the canonical space."""
    r, q, _ = cca(ref, query, dim, num_cc)
    r, q = stored(r, "space"), stored(q, "space")
    # tables of all cells by all neighbours are not needed: each step asks for the cells that the step before has left
    k = max(k_anchor, k_score)
    of = lambda t, ids, side: t.join(ids.select(F.col(side).alias("cell_id")).distinct(), "cell_id", "left_semi")
    nn = {"qr": stored(knn(r, q, k, metric="euclidean"), "nn")}
    nn["rq"] = stored(knn(q, of(r, nn["qr"].where(F.col("rank") <= k_anchor), "d"), k, metric="euclidean"), "nn")
    pairs = stored(anchor_pairs(nn["rq"], nn["qr"], k_anchor), "pairs")
    kept = stored(filter_anchors(pairs, knn(query, of(ref, pairs, "r"), k_filter), knn(ref, of(query, pairs, "q"), k_filter), k_filter), "anchors")
    nn["rr"] = stored(knn(latent, of(latent, kept, "r"), k + 1), "nn")
    nn["qq"] = stored(knn(q, of(q, kept, "q"), k + 1, metric="euclidean"), "nn")
    scored = stored(score_anchors(kept, nn, k_score), "anchors")
    if not scored.limit(1).count():
        raise ValueError("the two sides have no anchors")
    weights = stored(anchor_weights(scored, query, k_weight), "weights")
    return apply_correction(query, integration_vectors(scored, ref, query), weights)


def correct_in_chunks(ref: DataFrame, query: DataFrame, latent: DataFrame, dim: int, num_chunks: int = 1, seed: int = 0, **options) -> DataFrame:
    """correct() for each of num_chunks random parts of the query side against the whole reference; 1 is the exact form."""
    if num_chunks == 1:
        return correct(ref, query, latent, dim, **options)
    chunked = stored(query.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.lit(num_chunks))), "chunks")
    out = None
    for c in range(num_chunks):
        part = correct(ref, chunked.where(F.col("chunk") == c).select("cell_id", "vec"), latent, dim, **options)
        out = part if out is None else out.unionByName(part)
    return out
