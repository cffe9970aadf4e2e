"""The k most similar vectors of every vector: multiprobe p-stable hashing with exact reranking.

Vectors are centred and scaled to length one, so that 1 - Pearson correlation is half the squared Euclidean distance.
In each of `tables` tables a vector falls into the bucket that `hashes` Gaussian projections, cut into slots of
`width`, give it. A query visits its own bucket and then `probes` perturbed ones in the order of their estimated
success: the sum of squared distances to the slot walls that a perturbation crosses, ordered by the expected scores.
The rows of a bucket are compared as one block, and the pairs of all tables are reranked with the full vectors. What
travels to the buckets is small: for the nearest of all a vector in half precision; for those within a limit a sketch
of eight bytes, whose rounding is bounded so that no pair within the limit is passed over. A bucket of any size is cut
into chunks, each a block of its own, so nothing is capped or dropped.

How many tables and probes a wanted recall takes is measured, not set: `tuned` finds the true neighbours of some
queries among all rows and takes the cheapest tables that hold the wanted share of them, at whatever size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.session import small, stored, usable_vector


@dataclass(frozen=True)
class Hashing:
    """The tables: `hashes` projections in slots of `width`, `probes` perturbed buckets after the own one."""

    tables: int
    hashes: int
    width: float
    probes: int
    seed: int = 7

    def arrays(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        a = r.standard_normal((dim, self.tables * self.hashes)).astype(np.float32)
        b = r.random(self.tables * self.hashes).astype(np.float32) * self.width
        mult = r.integers(1, 2**63, self.tables * self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, b, mult

    def template(self) -> list[tuple[int, ...]]:
        """The first `probes` perturbation sets, as places in the order of a query's wall distances, by expected score."""
        m = self.hashes
        expect = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
        heap, out = [(expect[0], (0,))], []
        while heap and len(out) < self.probes:
            score, s = heapq.heappop(heap)
            if all(2 * m - 1 - j not in s for j in s):  # never both walls of one projection
                out.append(s)
            if s[-1] + 1 < 2 * m:
                heapq.heappush(heap, (score - expect[s[-1]] + expect[s[-1] + 1], (*s[:-1], s[-1] + 1)))
                heapq.heappush(heap, (score + expect[s[-1] + 1], (*s, s[-1] + 1)))
        return out

    def keys(self, z: np.ndarray, probing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys (n, tables) of all rows, and (queries, tables * probes) of the perturbed buckets of the rows marked in `probing`."""
        a, b, mult = self.arrays(z.shape[1])
        y = (z.astype(np.float32) @ a + b) / np.float32(self.width)
        slot = np.floor(y)
        own = (slot.astype(np.int64).astype(np.uint64) * mult).reshape(len(z), self.tables, self.hashes).sum(2, dtype=np.uint64)
        if probing is None or not self.probes or not probing.any():
            return own, np.zeros((0, 0), np.uint64)
        low = (y[probing] - slot[probing]).reshape(-1, self.tables, self.hashes)
        wall = np.concatenate([low, 1 - low], 2)
        order = np.argsort(wall, axis=2)
        m = mult.reshape(1, self.tables, self.hashes)
        step = np.take_along_axis(np.broadcast_to(np.concatenate([np.uint64(0) - m, m], 2), order.shape), order, 2)
        near = own[probing]
        return own, np.stack([near + step[:, :, list(s)].sum(2, dtype=np.uint64) for s in self.template()], 2).reshape(len(near), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to length one."""
    z = x - x.mean(1, keepdims=True)
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def _best(q: np.ndarray, d: np.ndarray, vq: np.ndarray, vd: np.ndarray, k: int, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the k nearest of d for each of q (those within `limit`, by squared distance, if given) and their distances, block by block."""
    nq, nd = (np.einsum("ij,ij->i", v, v) for v in (vq, vd)) if limit is not None else (None, None)
    rows, cols, dist = [], [], []
    for i in range(0, len(q), 1024):
        best_d = best_c = None
        for j in range(0, len(d), 8192):
            s = vq[i : i + 1024] @ vd[j : j + 8192].T
            s = 1.0 - s if limit is None else nq[i : i + 1024, None] + nd[None, j : j + 8192] - 2 * s
            if limit is not None:
                r, c = np.nonzero(s <= limit)
                rows.append(q[i + r])
                cols.append(d[j + c])
                dist.append(s[r, c])
                continue
            n = min(k, s.shape[1])
            c = np.argpartition(s, n - 1, axis=1)[:, :n]
            v = np.take_along_axis(s, c, 1)
            c = c + j
            if best_d is not None:
                v, c = np.concatenate([best_d, v], 1), np.concatenate([best_c, c], 1)
                keep = np.argpartition(v, min(k, v.shape[1]) - 1, axis=1)[:, :k]
                v, c = np.take_along_axis(v, keep, 1), np.take_along_axis(c, keep, 1)
            best_d, best_c = v, c
        if limit is None:
            rows.append(np.repeat(q[i : i + 1024], best_d.shape[1]))
            cols.append(d[best_c.ravel()])
            dist.append(best_d.ravel())
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


#: What a row does in a block: it is searched, it is searched and asks, it asks.
_INDEXED, _BOTH, _ASKS = 0, 1, 2


def _pairs_of_groups(group: np.ndarray, role: np.ndarray, v: np.ndarray, k: int, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups' candidate pairs (rows sorted by group and, within one, by role: the searched come first, those that ask last)."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    total = np.diff(np.concatenate([start, [len(group)]]))
    nq = np.add.reduceat((role != _INDEXED).astype(np.int64), start)
    nd = np.add.reduceat((role != _ASKS).astype(np.int64), start)
    first_q = start + total - nq
    rows, cols, dist = [], [], []
    little = (nq > 0) & (nd > 0) & (nq * nd <= 4096)
    g = np.flatnonzero(little)
    for part in np.array_split(g, max(1, -(-int((nq[g] * nd[g]).sum()) // 1_000_000))) if len(g) else []:
        n = nq[part] * nd[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nd[part], n)
        d = np.repeat(start[part], n) + at % width
        q = np.repeat(first_q[part], n) + at // width
        if limit is not None:
            apart = v[q] - v[d]
            s = np.einsum("ij,ij->i", apart, apart)
            keep = s <= limit
        else:
            s = 1.0 - np.einsum("ij,ij->i", v[q], v[d])
            order = np.lexsort((s, q))
            first = np.concatenate([[True], q[order][1:] != q[order][:-1]])
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            keep = order[rank < k]
        rows.append(q[keep])
        cols.append(d[keep])
        dist.append(s[keep])
    for i in np.flatnonzero((nq > 0) & (nd > 0) & ~little):
        d = np.arange(start[i], start[i] + nd[i])
        q = np.arange(first_q[i], start[i] + total[i])
        r, c, s = _best(q, d, v[q[0] : q[-1] + 1], v[d[0] : d[-1] + 1], k, limit)
        rows.append(r)
        cols.append(c)
        dist.append(s)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


#: Numbers of a sketch and their scale: a projection of a unit vector on an orthonormal axis fits a byte.
_AXES, _SCALE = 8, 127.0


def _axes(dim: int) -> np.ndarray:
    """Orthonormal axes for sketches, at right angles to the direction that centring takes away."""
    g = np.random.default_rng(23).standard_normal((dim, min(_AXES, dim - 1)))
    return np.linalg.qr(g - g.mean(0))[0]


def sketch(z: np.ndarray) -> np.ndarray:
    """Eight bytes for each unit vector, as a number: its projections on the axes, rounded."""
    out = np.zeros((len(z), _AXES), np.int8)
    axes = _axes(z.shape[1])
    out[:, : axes.shape[1]] = np.rint(z @ axes * _SCALE)
    return out.view(np.int64).ravel()


def sketch_limit(max_distance: float) -> float:
    """Squared distance of sketches up to which vectors can lie within a Pearson distance: projecting only brings them nearer, and rounding moves two sketches by at most one in each axis."""
    return float((_SCALE * np.sqrt(2 * max_distance) + np.sqrt(_AXES)) ** 2 + 1e-3)


def exact_distances(pairs: DataFrame, dim: int) -> DataFrame:
    """Replaces the vectors va and vb of pairs by dist, 1 - their Pearson correlation in double precision."""
    keep = [c for c in pairs.columns if c not in ("va", "vb")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                za, zb = (unit(_matrix(b.column(c), dim)) for c in ("va", "vb"))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(1.0 - np.einsum("ij,ij->i", za, zb))], names=[*keep, "dist"])

    return pairs.mapInArrow(measure, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep) + ", dist double")


def _usable(df: DataFrame, id_col: str, vec_col: str, dim: int, queries: Column | None) -> DataFrame:
    ask = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    return df.where(usable_vector(vec_col, dim) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"), ask.alias("ask"))


def tuned(df: DataFrame, id_col: str, vec_col: str, dim: int, *, k: int = 5, queries: Column | None = None, recall: float = 0.95, sample: int = 400, width: float = 1.2, most_tables: int = 10, most_probes: int = 96) -> Hashing:
    """Hash tables that find `recall` of the k nearest neighbours, by measurement on this table.

    For about `sample` of the queries, drawn by hash, the true neighbours are found among all rows by comparing with
    each; the vectors of these few pairs then tell for any tables which of the pairs meet. Of the tables that reach
    the recall the ones with the fewest copies of rows are taken. The projections of a bucket start at one for four
    times the rows, so that buckets grow with a root of them, and get fewer until the recall is reached.
    """
    rows = _usable(df, id_col, vec_col, dim, queries).select("vec", "ask")
    count, asking = rows.agg(F.count(F.lit(1)), F.sum(F.col("ask").cast("int"))).first()
    most = Hashing(tables=most_tables, hashes=4, width=width, probes=most_probes)
    if not asking or count < 2:
        return Hashing(tables=2, hashes=4, width=width, probes=8)
    drawn = rows.where(F.col("ask") & (F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / asking)))).select("vec").limit(2 * sample).collect()
    if not drawn:
        drawn = rows.where("ask").select("vec").limit(sample).collect()
    q = np.unique(unit(np.array([r[0] for r in drawn])), axis=0).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(q)  # at most 2 x sample vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = np.full((len(q), k), np.inf, np.float32)
        held = np.zeros((len(q), k, dim), np.float32)
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                z = unit(_matrix(b.column(0).slice(at, 8192), dim)).astype(np.float32)
                s = 1.0 - q @ z.T
                s[s < 1e-6] = np.inf  # the query itself and its copies, which cost no search
                n = min(k, s.shape[1])
                c = np.argpartition(s, n - 1, axis=1)[:, :n]
                every = np.concatenate([best, np.take_along_axis(s, c, 1)], 1)
                keep = np.argsort(every, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(every, keep, 1)
                held = np.take_along_axis(np.concatenate([held, z[c]], 1), keep[:, :, None], 1)
        at, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at, j].astype(np.float64)), pa.array(list(held[at, j]), pa.list_(pa.float32()))], names=["q", "s", "v"])

    near = rows.select("vec").mapInArrow(nearest, "q bigint, s double, v array<float>")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("s"))).where(F.col("rn") <= k).select("q", "v").collect()
    if not near:
        return Hashing(tables=2, hashes=4, width=width, probes=8)
    zq, zn = q[[r[0] for r in near]], np.array([r[1] for r in near], np.float32)
    share = asking / count
    for m in range(max(4, round(math.log2(max(2, count)) / 2)), 2, -1):
        most = Hashing(tables=most_tables, hashes=m, width=width, probes=most_probes)
        own, more = most.keys(zq, np.ones(len(zq), bool))
        there, _ = most.keys(zn)
        asked = np.concatenate([own[:, :, None], more.reshape(len(zq), most_tables, -1)], 2)
        met = asked == there[:, :, None]
        first = np.where(met.any(2), met.argmax(2), most_probes + 1)  # the probe at which a table meets the neighbour
        first = np.minimum.accumulate(first, axis=1)  # with that many tables
        ways = [(t * (1 + share * (1 + p)), t, p) for t in range(1, most_tables + 1) for p in range(0, most_probes + 1, 4) if (first[:, t - 1] <= p).mean() >= recall]
        if ways:
            _, t, p = min(ways)
            return Hashing(tables=t, hashes=m, width=width, probes=p)
    return Hashing(tables=most_tables, hashes=3, width=width, probes=most_probes)


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, *, k: int = 5, max_distance: float | None = None, queries: Column | None = None, hashing: Hashing, chunk: int = 4096, slack: int = 5) -> DataFrame:
    """(query_id, neighbour_id, nn_rank, nn_dist): for each query id its k nearest other ids by 1 - Pearson correlation.

    With max_distance only neighbours within it. `queries` marks the rows that ask (default: all); all are searched.
    Vectors that are null, not `dim` long, constant, or with a null or NaN element take no part, nor do null ids.
    Identical vectors are hashed once and share their neighbours, so copies cost no pairs; an id with several vectors
    counts with the nearest. Ties go to the smaller id. An empty table gives an empty result.
    """
    within = max_distance is not None
    # classes of identical vectors are named by 96 bits of hashes; only the vectors of such classes are gathered
    name = ["h1", "h2"]
    rows = _usable(df, id_col, vec_col, dim, queries).select("id", "ask", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    twice = small(stored(rows.select(*name).groupBy(*name).count().where("count > 1").select(*name), "copies"))
    members = stored(rows.join(twice, name, "left_semi").groupBy(*name, "id").agg(F.max("ask").alias("ask"), F.first("vec").alias("vec")), "members")
    classes = members.groupBy(*name).agg(F.min("id").alias("rep"), F.max("ask").alias("ask"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    alone = rows.join(twice, name, "left_anti").select(*name, F.col("id").alias("rep"), "ask", F.lit(1).cast("bigint").alias("n"), "vec")
    reps = stored(alone.unionByName(classes).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # of a class with several members the first k + 1 can be anyone's neighbours; the window prunes before it shuffles
    crowd = members.select(*name, "id", "ask").join(small(stored(reps.where("n > 1").select(*name, "rid"), "crowded")), name).select("rid", "id", "ask")
    few = crowd.withColumn("rn", F.row_number().over(Window.partitionBy("rid").orderBy("id"))).where(F.col("rn").between(2, k + 1)).select("rid", "id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, _ = hashing.keys(unit(_matrix(b.column(1), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel().view(np.int64))], names=["key"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                z = unit(_matrix(b.column(1), dim))
                asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                own, more = hashing.keys(z, asks)
                rid = np.arange(len(z))
                q = rid[asks]
                key = np.concatenate([own.ravel(), more.ravel()])
                row = np.concatenate([np.repeat(rid, own.shape[1]), np.repeat(q, more.shape[1] if more.size else 0)])
                role = np.concatenate([np.repeat(np.where(asks, _BOTH, _INDEXED), own.shape[1]), np.full(more.size, _ASKS)]).astype(np.int8)
                if within:
                    v = pa.array(sketch(z)[row])
                else:
                    half = np.ascontiguousarray(z.astype(np.float16))
                    v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(z), [None, pa.py_buffer(half.tobytes())]).cast(pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), b.column(0).take(pa.array(row)), v], names=["key", "role", "rid", "v"])

    hashed = reps.select("rid", "vec", "ask")
    counts = hashed.mapInArrow(index, "key bigint").groupBy("key").count()
    hot = stored(counts.where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "hot")
    blocks = hashed.mapInArrow(place, f"key bigint, role tinyint, rid bigint, v {'bigint' if within else 'binary'}")
    if hot.limit(1).count():
        # in a bucket of several chunks a vector is searched in one of them and asks in all
        home = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        spread = (
            F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("chunk"), F.col("role").alias("role"))))
            .when(F.col("role") == _INDEXED, F.array(F.struct(home.alias("chunk"), F.col("role").alias("role"))))
            .otherwise(F.transform(every, lambda c: F.struct(c.alias("chunk"), F.when((F.col("role") == _BOTH) & (c == home), F.lit(_BOTH)).otherwise(F.lit(_ASKS)).cast("tinyint").alias("role"))))
        )
        # blocks that share a hash are compared as one: candidates are never lost
        blocks = blocks.join(small(hot, 1_000_000), "key", "left").select("key", F.inline(spread), "rid", "v").select(F.xxhash64("key", "chunk").alias("block"), "role", "rid", "v")
    else:
        blocks = blocks.withColumnRenamed("key", "block")
    blocks = blocks.repartition("block").sortWithinPartitions("block", "role")
    want = k + slack

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            rid = t.column("rid").to_numpy()
            if within:
                v = np.ascontiguousarray(t.column("v").to_numpy()).view(np.int8).reshape(-1, _AXES).astype(np.float32)
                r, c, s = _pairs_of_groups(t.column("block").to_numpy(), t.column("role").to_numpy(), v, want + 1, sketch_limit(max_distance))
                a, b = rid[r], rid[c]
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.zeros(len(pair), np.float32))], names=["a", "b", "s"])
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            r, c, s = _pairs_of_groups(t.column("block").to_numpy(), t.column("role").to_numpy(), v, want + 1, None)
            other = rid[r] != rid[c]
            return pa.RecordBatch.from_arrays([pa.array(rid[r[other]]), pa.array(rid[c[other]]), pa.array(s[other].astype(np.float32))], names=["a", "b", "s"])

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < 50_000:
                continue
            t = pa.Table.from_batches(held)
            last = t.column("block")[size - 1].as_py()
            cut = int(np.searchsorted(t.column("block").to_numpy(), last))  # sorted: the last block may go on
            if cut:
                yield done(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), size - cut
        if held:
            yield done(pa.Table.from_batches(held))

    found = blocks.mapInArrow(compare, "a bigint, b bigint, s float").groupBy("a", "b").agg(F.min("s").alias("s"))
    if not within:
        found = found.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("s", "b"))).where(F.col("rn") <= want)
    pairs = stored(found.select("a", "b"), "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids")
    needed = stored(reps.select("rid", "rep", "ask", "vec").join(small(ids, 1_000_000), "rid", "left_semi"), "needed")
    side = lambda x: needed.select(F.col("rid").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("ask").alias(f"ask_{x}"), F.col("vec").alias(f"v{x}"))
    exact = exact_distances(pairs.join(side("a"), "a").join(side("b"), "b"), dim)
    one_way = exact.where("ask_a").select(F.col("a").alias("q"), F.col("b").alias("d"), F.col("rep_b").alias("neighbour_id"), "dist")
    if within:
        exact = stored(exact.where(F.col("dist") <= max_distance), "exact")
        one_way = exact.where("ask_a").select(F.col("a").alias("q"), F.col("b").alias("d"), F.col("rep_b").alias("neighbour_id"), "dist")
        one_way = one_way.unionByName(exact.where("ask_b").select(F.col("b").alias("q"), F.col("a").alias("d"), F.col("rep_a").alias("neighbour_id"), "dist"))
    # a class is its own nearest, and stands for its first members: its representative and those of `few`
    itself = reps.where("ask AND n > 1").select(F.col("rid").alias("q"), F.col("rid").alias("d"), F.col("rep").alias("neighbour_id"), F.lit(0.0).alias("dist"))
    exact = stored(one_way.unionByName(itself), "pairs")
    others = exact.drop("neighbour_id").join(few.select(F.col("rid").alias("d"), F.col("id").alias("neighbour_id")), "d")
    near = exact.unionByName(others).groupBy("q", "neighbour_id").agg(F.min("dist").alias("dist"))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("dist", "neighbour_id"))).where(F.col("rn") <= (k + 1) * 2).drop("rn")
    near = stored(near, "pairs")
    # who asks: the members of crowded classes, the representatives of all others
    asking = crowd.where("ask").select(F.col("rid").alias("q"), F.col("id").alias("query_id")).unionByName(reps.where("n = 1 AND ask").select(F.col("rid").alias("q"), F.col("rep").alias("query_id")))
    out = asking.join(small(near), "q").where(F.col("query_id") != F.col("neighbour_id")).groupBy("query_id", "neighbour_id").agg(F.min("dist").alias("nn_dist"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nn_dist", "neighbour_id"))
    return out.withColumn("nn_rank", rank).where(F.col("nn_rank") <= k).select("query_id", "neighbour_id", "nn_rank", "nn_dist")
