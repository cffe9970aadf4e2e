"""Exact k nearest neighbours by correlation or Euclidean distance, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.session import small, stored

#: Numbers on the searched side, or with the queries, up to which it is sent whole to each executor (8 bytes each).
BROADCAST_NUMBERS = 4_000_000
#: Decimals that distances are rounded to before they are ranked, so that ties fall to the smaller id.
DIGITS = 9


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows and the longest vector of (cell_id, vec)."""
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    return n, max(1, dim or 0)


def _vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix; null elements become NaN."""
    width = pc.unique(pc.list_value_length(col)).to_pylist()
    if len(width) > 1 or None in width:
        raise ValueError("vectors must have one length and not be null")
    flat = pc.list_flatten(col)
    return np.asarray(flat.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Array) else flat.to_numpy(), float).reshape(len(col), width[0] if width else 0)


def _prepare(x: np.ndarray, metric: str) -> np.ndarray:
    x = np.asarray(x, float)
    if metric == "euclidean":
        return x
    z = x - x.mean(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return z / np.linalg.norm(z, axis=1, keepdims=True)


def _block_top(q: np.ndarray, d: np.ndarray, rank_of: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and distances of the k nearest for each query row; ties by rank_of; NaN last."""
    if metric == "euclidean":
        s = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * q @ d.T, 0))
    else:
        s = 1 - q @ d.T
    s = np.round(s, DIGITS)
    s[np.isnan(s)] = np.inf
    n = min(k, s.shape[1])
    if n < s.shape[1]:
        kth = np.partition(s, n - 1, axis=1)[:, n - 1 : n]
        r, c = np.nonzero(s <= kth)
    else:
        r, c = np.nonzero(np.ones_like(s, bool))
    order = np.lexsort((rank_of[c], s[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(q)))
    take = np.arange(len(r)) - first[r] < n
    cols, dist = c[take].reshape(len(q), n), s[r[take], c[take]].reshape(len(q), n)
    if metric == "euclidean":  # the product form loses digits for close points
        exact = np.round(np.sqrt(((q[:, None, :] - d[cols]) ** 2).sum(2)), DIGITS)
        dist = np.where(np.isinf(dist), dist, exact)
    return cols, dist


def _improve(dist: np.ndarray, pos: np.ndarray, q: np.ndarray, d: np.ndarray, first: int, metric: str) -> None:
    """Sets the rows of d, at the places first, first + 1, ..., among the nearest so far (dist, pos) of the rows of q, in place.

    Place -1 is free. Of equal distances the earlier place comes first, so one that stands is only displaced by a
    smaller distance, and the bound on the products leaves few to look at.
    """
    k = dist.shape[1]
    no_q, no_d = ~np.isfinite(q).all(1), ~np.isfinite(d).all(1)
    q, d = np.where(no_q[:, None], 0, q), np.where(no_d[:, None], 0, d)
    worst, free = dist[:, -1].copy(), pos[:, -1] < 0
    s = q @ d.T
    if metric == "euclidean":
        qq, dd = (q * q).sum(1), (d * d).sum(1)
        near = dd[None, :] - 2 * s < (worst * worst - qq + 1e-12 * (1 + qq + dd.max()))[:, None]
    else:
        near = s > (1 - worst - 1e-12)[:, None]
    near[free] = True
    near[no_q & ~free] = False
    r, c = np.nonzero(near)
    if metric == "euclidean":
        v = np.concatenate([np.sqrt(((q[r[i : i + 200_000]] - d[c[i : i + 200_000]]) ** 2).sum(1)) for i in range(0, max(1, len(r)), 200_000)])
    else:
        v = 1 - s[r, c]
    v = np.round(v, DIGITS) + 0.0
    v[no_q[r] | no_d[c]] = np.inf
    keep = free[r] | (v < worst[r])
    r, c, v = r[keep], c[keep], v[keep]
    if not len(r):
        return
    rows, at = np.unique(r, return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
    v, p = np.concatenate([dist[rows].ravel(), v]), np.concatenate([pos[rows].ravel(), first + c])
    order = np.lexsort((np.where(p < 0, np.iinfo(np.int64).max, p), v, row))
    take = order[np.searchsorted(row[order], np.arange(len(rows)))[:, None] + np.arange(k)]
    dist[rows], pos[rows] = v[take], p[take]


def _streamed(data: DataFrame, query: DataFrame, want: int, metric: str, schema: str, rows: int) -> DataFrame:
    """(q, d, dist): for each part of data, of a million rows at most or so, the nearest of its rows for each query. The queries are held by each executor."""
    t = query.toArrow()
    shared = data.sparkSession.sparkContext.broadcast((t.column("cell_id").combine_chunks(), _prepare(_vectors(t.column("vec")), metric)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, mat = shared.value
        dist, pos = np.full((len(mat), want), np.inf), np.full((len(mat), want), -1, np.int64)
        ids, seen = [], 0
        for b in batches:
            x = _prepare(_vectors(b.column(1)), metric) if b.num_rows else np.zeros((0, 0))
            ids.append(b.column(0))
            at = 0
            while at < len(x):
                step = min(4096, max(64, want, seen))  # few rows first, so that the bounds are close when there are many
                for i in range(0, len(mat), 1024):
                    _improve(dist[i : i + 1024], pos[i : i + 1024], mat[i : i + 1024], x[at : at + step], seen, metric)
                seen += len(x[at : at + step])
                at += step
        names = pa.chunked_array(ids).combine_chunks() if seen else None
        for i in range(0, len(mat) if seen else 0, 4096):
            r, c = np.nonzero(pos[i : i + 4096] >= 0)
            yield pa.RecordBatch.from_arrays([asks.take(pa.array(r + i)), names.take(pa.array(pos[r + i, c])), pa.array(dist[r + i, c])], names=["q", "d", "dist"])

    parts = max(data.sparkSession.sparkContext.defaultParallelism, -(-rows // 1_000_000))
    return data.repartition(parts, "cell_id").sortWithinPartitions("cell_id").mapInArrow(search, schema)


def knn(data: DataFrame, query: DataFrame, k: int, *, metric: str = "correlation", drop_self: bool = False, block: int = 4096) -> DataFrame:
    """(q, d, rank, dist) for (cell_id, vec) tables: the k nearest rows of data for each row of query.

    Distances are 1 - Pearson correlation or Euclidean, rounded to nine digits; ties go to the smaller id; a cell is
    its own first neighbour unless drop_self. Constant vectors have no correlation and rank last with a null distance.
    k is clamped to the rows of data. A small side is held whole by each executor, the searched one or that of the
    queries, past which the searched rows stream; two large sides meet in a grid of blocks whose best are merged, so no
    task holds more than one block of each.
    """
    if metric not in ("correlation", "euclidean"):
        raise ValueError("metric is correlation or euclidean")
    want = k + 1 if drop_self else k
    data = data.select("cell_id", "vec")
    query = query.select("cell_id", "vec")
    id_type = data.schema["cell_id"].dataType.simpleString()
    q_type = query.schema["cell_id"].dataType.simpleString()
    rows, dim = _size(data)
    schema = f"q {q_type}, d {id_type}, dist double"
    asks = _size(query)[0] if rows * dim > BROADCAST_NUMBERS // 4 else 0
    held = asks * max(dim, 2 * want)  # the queries and the nearest of each so far
    if asks and held <= BROADCAST_NUMBERS and held < rows * dim:
        best = _streamed(data, query, want, metric, schema, rows)
    elif rows * dim <= BROADCAST_NUMBERS:
        t = data.toArrow()
        ids = t.column("cell_id").combine_chunks()
        rank_of = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable") if rows else np.zeros(0, int)
        mat = _prepare(_vectors(t.column("vec")), metric) if rows else np.zeros((0, 0))
        shared = data.sparkSession.sparkContext.broadcast((ids, rank_of, mat))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rank_of, mat = shared.value
            step = max(1, min(1024, 8_000_000 // max(1, len(mat))))
            for b in batches:
                for at in range(0, b.num_rows if len(mat) else 0, step):
                    part = b.slice(at, step)
                    q = _prepare(_vectors(part.column(1)), metric)
                    cols, dist = _block_top(q, mat, rank_of, want, metric)
                    n = cols.shape[1]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(q)), n))), ids.take(pa.array(cols.ravel())), pa.array(dist.ravel())], names=["q", "d", "dist"])

        best = query.mapInArrow(search, schema)
    else:
        nq, nd = max(1, -(-asks // block)), max(1, -(-rows // block))
        # both sides name a block by the same type: keys of two types are hashed to different tasks and never meet
        own = lambda n: F.pmod(F.xxhash64("cell_id"), F.lit(n)).cast("int")
        left = query.select(own(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"), F.col("cell_id").alias("id"), F.col("vec").alias("v"))
        right = data.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), own(nd).alias("db"), F.col("cell_id").alias("id"), F.col("vec").alias("v"))  # new names, as both may come from one table

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            ids, names = d.column("id").combine_chunks(), q.column("id").combine_chunks()
            if not len(ids) or not len(names):
                return pa.table({"q": names.slice(0, 0), "d": ids.slice(0, 0), "dist": pa.array([], pa.float64())})
            rank_of = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable")
            cols, dist = _block_top(_prepare(_vectors(q.column("v")), metric), _prepare(_vectors(d.column("v")), metric), rank_of, want, metric)
            n = cols.shape[1]
            return pa.table({"q": names.take(pa.array(np.repeat(np.arange(len(names)), n))), "d": ids.take(pa.array(cols.ravel())), "dist": dist.ravel()})

        best = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(meet, schema)
    if drop_self:
        best = best.where("q <> d")
    by = Window.partitionBy("q").orderBy("dist", "d")
    out = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("q", "d", "rank", F.when(F.col("dist") < float("inf"), F.col("dist")).alias("dist"))


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - Pearson correlation of two arrays as one expression; null for constant arrays."""
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    ca, cb = F.transform(a, lambda x: x - mean(a)), F.transform(b, lambda x: x - mean(b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(norm > 0, F.lit(1.0) - dot(ca, cb) / norm)


def find_nn(ref: DataFrame, query: DataFrame, k: int = 300) -> dict[str, DataFrame]:
    """The four Euclidean tables of a shared space: rr and qq with k + 1 neighbours (the cell itself first), rq and qr with k."""
    return {"rr": knn(ref, ref, k + 1, metric="euclidean"), "qq": knn(query, query, k + 1, metric="euclidean"), "rq": knn(query, ref, k, metric="euclidean"), "qr": knn(ref, query, k, metric="euclidean")}


def find_nn_rna(ref: DataFrame, query: DataFrame, rna: DataFrame, cite_index: int = 1, k: int = 300) -> dict[str, DataFrame]:
    """As find_nn(), but the side that has transcripts finds its own neighbours by correlation in their latent space."""
    own = knn(rna, rna, k + 1)
    out = {"rq": knn(query, ref, k, metric="euclidean"), "qr": knn(ref, query, k, metric="euclidean")}
    if cite_index == 1:
        return out | {"rr": own, "qq": knn(query, query, k + 1, metric="euclidean")}
    return out | {"rr": knn(ref, ref, k + 1, metric="euclidean"), "qq": own}


#: Grid levels that points start from, as powers of two of the side that an even spread would need.
_FINEST, _COARSEST = -7, 2


def spatial_knn(points: DataFrame, k: int, *, axes: tuple[str, ...] = ("x", "y", "z"), max_rounds: int = 64) -> DataFrame:
    """(q, d, rank, dist): the k nearest other cells by position, exactly, through a grid as fine as each place is dense.

    points: (cell_id, axes), one row per cell. Every point starts at the finest level at which its own grid cell holds
    more than k points but is not crowded, and looks into the 3^n cells around it; it is done when k neighbours are
    nearer than the walls of these cells. The others go on one level coarser. Null and NaN positions take no part.
    """
    n = len(axes)
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a)
    pts = stored(points.where(ok).select("cell_id", *[F.col(a).cast("double").alias(f"a{i}") for i, a in enumerate(axes)]), "points")
    box = pts.agg(F.count(F.lit(1)).alias("n"), *[(F.max(f"a{i}") - F.min(f"a{i}")).alias(f"s{i}") for i in range(n)]).first()
    spans = [box[f"s{i}"] for i in range(n) if box[f"s{i}"]]
    total = box["n"]
    if total < 2:
        return pts.select(F.col("cell_id").alias("q"), F.col("cell_id").alias("d"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist")).limit(0)
    k = min(k, total - 1)
    even = float(np.exp((np.log(spans).sum() + np.log((k + 1) / total)) / len(spans))) if spans else 1.0
    widest = max(spans, default=1.0)
    fine, keys = [f"f{i}" for i in range(n)], [f"k{i}" for i in range(n)]

    # the level of each occupied finest cell, from the counts of the cells around it at all levels
    placed = pts.select("*", *[F.floor(F.col(f"a{i}") / F.lit(even * 2.0**_FINEST)).alias(f) for i, f in enumerate(fine)])
    cells = placed.groupBy(*fine).agg(F.count(F.lit(1)).alias("c"))
    nested = cells.select("*", F.explode(F.sequence(F.lit(_FINEST), F.lit(_COARSEST))).alias("level")).select("*", *[F.expr(f"shiftright({f}, level - ({_FINEST}))").alias(c) for f, c in zip(fine, keys)])
    counts = stored(nested.groupBy("level", *keys).agg(F.sum("c").alias("held")), "cells")
    crowd = 64 * (k + 1)
    hot = small(counts.where(F.col("held") > 64 * crowd).select("level", *keys), 1_000_000)  # at most levels x points / (64 x crowd) cells
    known = nested.join(hot, ["level", *keys], "left_anti").join(counts.where(F.col("held") <= crowd), ["level", *keys])
    level = known.groupBy(*fine).agg(F.coalesce(F.min(F.when(F.col("held") > k, F.col("level"))), F.max("level")).alias("level"))
    left = stored(placed.join(level, fine, "left").select("cell_id", *[f"a{i}" for i in range(n)], F.coalesce("level", F.lit(_FINEST)).alias("level")), "left")

    out, step = None, 1
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in product((-1, 0, 1), repeat=n)])
    side = F.lit(even) * F.pow(F.lit(2.0), F.col("level"))
    cell = [F.floor(F.col(f"a{i}") / side) for i in range(n)]
    for _ in range(max_rounds):
        used = [r[0] for r in left.select("level").distinct().collect()]  # a few dozen numbers at most
        if not used:
            break
        data = pts.withColumn("level", F.explode(F.array(*[F.lit(x) for x in used]))).select("level", *[c.alias(x) for c, x in zip(cell, keys)], F.col("cell_id").alias("d"), *[F.col(f"a{i}").alias(f"b{i}") for i in range(n)])
        last = side >= F.lit(widest)
        # all points nearer than this lie in the cells looked at: a side, and what is left to the nearest wall of the own cell
        inner = [F.col(f"a{i}") - c * side for i, c in enumerate(cell)]
        reach = F.when(last, F.lit(float("inf"))).otherwise(side * (1 - 1e-9) + F.greatest(F.lit(0.0), F.least(*[x for f in inner for x in (f, side - f)])))
        asks = left.select("*", reach.alias("reach"), F.inline(offsets)).select("cell_id", "level", "reach", *[f"a{i}" for i in range(n)], *[(cell[i] + F.col(f"o{i}")).alias(x) for i, x in enumerate(keys)])
        cand = asks.join(data, ["level", *keys]).where("cell_id <> d")
        apart = [F.col(f"a{i}") - F.col(f"b{i}") for i in range(n)]
        near = cand.select(F.col("cell_id").alias("q"), "d", sum((x * x for x in apart), F.lit(0.0)).alias("d2"), "reach").where(F.col("d2") < F.col("reach") * F.col("reach"))
        best = near.select("q", "d", F.round(F.sqrt("d2"), DIGITS).alias("dist"), "reach")
        top = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "d"))).where(F.col("rank") <= k)
        full = F.count(F.lit(1)).over(Window.partitionBy("q"))  # at most k rows each
        top = stored(top.withColumn("full", full).where((F.col("full") >= k) | (F.col("reach") == float("inf"))).select("q", "d", "rank", "dist"), "near")
        out = top if out is None else out.unionByName(top)
        left = stored(left.where(~last).join(top.where("rank = 1").select("q"), F.col("cell_id") == F.col("q"), "left_anti").withColumn("level", F.col("level") + step), "left")
        step = 2
    return out.select("q", "d", "rank", "dist")


def closest_points(points: DataFrame, x: float, y: float, n: int = 1, max_distance: float = float("inf")) -> DataFrame:
    """(cell_id, dist): the n points nearest to a place and nearer than max_distance."""
    d = F.sqrt((F.col("x") - F.lit(float(x))) ** 2 + (F.col("y") - F.lit(float(y))) ** 2)
    return points.select("cell_id", d.alias("dist")).where(F.col("dist") < F.lit(float(max_distance))).orderBy("dist", "cell_id").limit(n)
