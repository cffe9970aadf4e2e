"""Clusters of cells: Louvain on a neighbour graph, density clusters over a grid of settings, their consensus, silhouettes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.operators.knn import knn
from cellweft.session import cut, stored


def graph_edges(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """(a, b, w): the undirected multigraph of the first k neighbours, its double edges as weights; self-loops stay."""
    e = neighbours if k is None else neighbours.where(F.col("rank") <= k)
    return e.groupBy(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def louvain(edges: DataFrame, *, levels: int | None = None, sweeps: int | None = None, resolution: float = 1.0) -> DataFrame:
    """(cell_id, cluster): communities of high modularity of an undirected graph (a, b, w).

    In each sweep every node weighs the communities of its neighbours at once and moves to the best one; half of the
    nodes, by a hash that changes with the sweep, may move, which keeps pairs from swapping for ever. Communities then
    become the nodes of the next level. A level ends when no node would move, or when in four sweeps, in which each node
    had two turns, the modularity gained less than 1e-7; the last level is the one that gains no more. `levels` and
    `sweeps` end it earlier where given. All steps are joins and sums; clusters are numbered from the largest.
    """
    both = edges.where("a <> b").select("a", "b", "w").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(edges.where("a = b").select("a", "b", (F.col("w") * 2).alias("w")))
    graph = stored(both, "graph")
    names = stored(graph.groupBy("a").agg(F.lit(1).alias("one")).select(F.col("a").alias("cell_id"), F.col("a").alias("node")), "nodes")
    level_edges = graph
    total = graph.agg(F.sum("w")).first()[0]
    if not total:
        return names.select("cell_id", F.row_number().over(Window.orderBy("cell_id")).alias("cluster"))
    best = -1.0
    for level in count() if levels is None else range(levels):
        degree = stored(level_edges.groupBy("a").agg(F.sum("w").alias("k")), "degree")
        comm = cut(degree.select(F.col("a").alias("node"), F.col("a").alias("c"), "k"))
        top, idle = -1.0, 0
        for sweep in count() if sweeps is None else range(sweeps):
            size = comm.groupBy("c").agg(F.sum("k").alias("tot"))
            to = level_edges.where("a <> b").join(comm.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            own = comm.select(F.col("node").alias("a"), F.col("c").alias("own"), "k")
            gain = (
                to.unionByName(own.select("a", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
                .join(size, "c").join(own, "a")
                .withColumn("gain", F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(total))
            )
            pick = gain.groupBy("a").agg(F.max_by("c", F.struct(F.round("gain", 9), (F.col("c") == F.col("own")).cast("int"), F.col("c"))).alias("to"))
            turn = F.pmod(F.xxhash64("node", F.lit(level), F.lit(sweep // 2)), F.lit(2)) == sweep % 2
            moved = comm.join(pick, comm.node == pick.a).select("node", F.when(turn, F.col("to")).otherwise(F.col("c")).alias("c"), "k", (F.col("to") != F.col("c")).alias("m"))
            moved = cut(moved)
            comm = moved.drop("m")
            if not moved.where("m").limit(1).count():  # of all nodes, whether or not it is their turn
                break
            if sweep % 2:
                q = modularity(level_edges, comm, total, resolution)
                idle, top = (0, q) if q > top + 1e-7 else (idle + 1, top)
                if idle >= 2:
                    break
        q = modularity(level_edges, comm, total, resolution)
        if q <= best + 1e-7:
            break
        best = q
        names = stored(names.join(comm.select("node", "c"), "node").select("cell_id", F.col("c").alias("node")), "nodes")
        c = comm.select("node", "c")
        level_edges = stored(
            level_edges.join(c.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
            .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "graph")
    sizes = names.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.col("n").desc(), "node")))  # one row for each cluster
    return names.join(numbered, "node").select("cell_id", "cluster")


def modularity(both: DataFrame, comm: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Modularity of communities (node, c, k) in a graph given in both directions."""
    c = comm.select("node", "c")
    inside = both.join(c.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    spread = comm.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / total - resolution * spread / total**2


def silhouette(points: DataFrame, labels: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(mean_silhouette, n): the mean of (b - a) / max(a, b) over all points (cell_id, vec); null for fewer than two labels, 0 for a point alone in its label.

    Each block of points meets each block once; what leaves a block is one sum per point and label.
    """
    p = points.join(labels.select("cell_id", F.col("cluster").cast("string").alias("cluster")), "cell_id").select("cell_id", "vec", "cluster")
    p = stored(p, "points")
    n = max(1, -(-p.count() // 2048))
    left = p.select(F.pmod(F.xxhash64("cell_id"), F.lit(n)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"), "cell_id", "vec", "cluster")
    right = p.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("x"), F.pmod(F.xxhash64("cell_id"), F.lit(n)).alias("y"), "cell_id", "vec", "cluster")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"cell_id": [], "cluster": [], "other": [], "s": []})
        u, v = np.stack(a["vec"]).astype(float), np.stack(b["vec"]).astype(float)
        names, at = np.unique(b["cluster"].to_numpy(str), return_inverse=True)
        d = np.empty((len(u), len(v)))
        for i in range(0, len(u), 128):
            d[i : i + 128] = np.sqrt(((u[i : i + 128, None, :] - v[None, :, :]) ** 2).sum(2))
        sums = np.stack([d[:, at == j].sum(1) for j in range(len(names))], 1)
        return pd.DataFrame({"cell_id": np.repeat(a["cell_id"].to_numpy(), len(names)), "cluster": np.repeat(a["cluster"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "s": sums.ravel()})

    kind = p.schema["cell_id"].dataType.simpleString()
    sums = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(meet, f"cell_id {kind}, cluster string, other string, s double")
    size = p.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("cell_id", "cluster", "other").agg(F.sum("s").alias("s")).join(size, "other")
    own = F.col("cluster") == F.col("other")
    ab = per.groupBy("cell_id").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    width = F.when(F.col("n") == 1, F.lit(0.0)).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return ab.where("b IS NOT NULL").agg(F.avg(width).alias("mean_silhouette"), F.count(F.lit(1)).alias("n"))


# Density clusters of a sample that fits one task (the scan of the reference is a grid of such runs).


def hdbscan_labels(x: np.ndarray, min_samples: int, min_cluster_size: int, metric: str = "correlation") -> np.ndarray:
    """Labels 0.. and -1: single linkage of mutual reachability distances, condensed, clusters of the largest stability.

    x has the rows of one task (thousands); time and memory grow with their square.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    if metric == "correlation":
        z = x - x.mean(1, keepdims=True)
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        z = z / np.where(norm > 0, norm, 1)
        d = np.maximum(0.0, 1 - z @ z.T)
    else:
        d = np.sqrt(np.maximum(0.0, ((x[:, None] - x[None]) ** 2).sum(2)))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(n - 1, max(0, min_samples - 1))]
    # Prim's tree on mutual reachability
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    tree, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(d[at], core), core[at])
        closer = (reach < best) & ~inside
        best[closer], link[closer] = reach[closer], at
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((best[nxt], link[nxt], nxt))
        at = nxt
    tree.sort(key=lambda e: e[0])
    parent, node_of, children, size = list(range(n)), list(range(n)), {}, [1] * n
    find = lambda i: i if parent[i] == i else find_root(parent, i)
    for w, a, b in tree:
        ra, rb = find(a), find(b)
        new = len(size)
        children[new] = (node_of[ra], node_of[rb], w)
        size.append(size[node_of[ra]] + size[node_of[rb]])
        parent[rb] = ra
        node_of[ra] = new
    root = len(size) - 1
    lam = lambda w: 1 / w if w > 0 else 1e12
    # condense: walk down; splits with two large parts make clusters
    stability, kids, members, top = {0: 0.0}, {0: []}, {0: []}, {}
    stack, count = [(root, 0, 0.0)], 1
    while stack:
        node, cl, birth = stack.pop()
        if node < n:
            members[cl].append(node)
            continue
        a, b, w = children[node]
        here = lam(w)
        big = [c for c in (a, b) if size[c] >= min_cluster_size]
        if len(big) == 2:
            stability[cl] += (here - birth) * size[node]
            for c in big:
                stability[count], kids[count], members[count] = 0.0, [], []
                kids[cl].append(count)
                top[count] = cl
                stack.append((c, count, here))
                count += 1
        elif len(big) == 1:
            gone = a if big[0] == b else b
            stability[cl] += (here - birth) * size[gone]
            members[cl] += leaves(gone, children, n)
            stack.append((big[0], cl, birth))
        else:
            stability[cl] += (here - birth) * size[node]
            members[cl] += leaves(node, children, n)
    value, chosen = dict(stability), {}
    for c in range(count - 1, -1, -1):
        below = sum(value[k] for k in kids[c])
        chosen[c] = c != 0 and (not kids[c] or stability[c] >= below)
        value[c] = stability[c] if chosen[c] else below
    out, nxt = np.full(n, -1), 0
    pending = [0]
    while pending:
        c = pending.pop(0)
        if chosen[c]:
            todo = [c]
            while todo:
                k = todo.pop()
                out[members[k]] = nxt
                todo += kids[k]
            nxt += 1
        else:
            pending += kids[c]
    return out


def find_root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def leaves(node: int, children: dict, n: int) -> list[int]:
    out, stack = [], [node]
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            stack += children[k][:2]
    return out


#: Cells up to which a density scan is run: each grid point holds all pairs of cells in one task.
SCAN_CELLS = 20_000


def parameter_scan(latent: DataFrame, min_cluster_sizes: list[int], min_samples: list[int]) -> tuple[DataFrame, DataFrame]:
    """(run_id, min_samples, min_cluster_size, silhouette) and (run_id, cell_id, label) of density clusters over a grid, one task for each setting.

    A run needs all pairs of its cells; more than SCAN_CELLS cells are an error (the similarity clusters of large
    tables have an operator of their own). The silhouette is Euclidean, with -1 as a cluster; null for one label.
    """
    if latent.limit(SCAN_CELLS + 1).count() > SCAN_CELLS:
        raise ValueError(f"a density scan takes at most {SCAN_CELLS} cells")
    rows = latent.orderBy("cell_id").collect()
    ids, x = [r["cell_id"] for r in rows], np.array([r["vec"] for r in rows], float)
    spark = latent.sparkSession
    shared = spark.sparkContext.broadcast((ids, x))
    grid = [(i, s, c) for i, (s, c) in enumerate((s, c) for s in min_samples for c in min_cluster_sizes)]
    runs = spark.createDataFrame(grid, "run_id int, min_samples int, min_cluster_size int").repartition(max(1, len(grid)), "run_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        for b in batches:
            for r in b.itertuples():
                label = hdbscan_labels(x, int(r.min_samples), int(r.min_cluster_size))
                yield pd.DataFrame({"run_id": r.run_id, "min_samples": r.min_samples, "min_cluster_size": r.min_cluster_size, "cell_id": ids, "label": label, "silhouette": silhouette_of(x, label)})

    kind = latent.schema["cell_id"].dataType.simpleString()
    got = stored(runs.mapInPandas(run, f"run_id int, min_samples int, min_cluster_size int, cell_id {kind}, label int, silhouette double"), "runs")
    return got.select("run_id", "min_samples", "min_cluster_size", "silhouette").distinct(), got.select("run_id", "cell_id", "label")


def silhouette_of(x: np.ndarray, label: np.ndarray) -> float | None:
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return None
    one = np.eye(len(names))[at]
    n = one.sum(0)
    out = []
    for i in range(0, len(x), 256):
        d = np.sqrt(np.maximum(0, (x[i : i + 256] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i : i + 256] @ x.T))
        s = d @ one
        mine = at[i : i + 256]
        a = s[np.arange(len(s)), mine] / np.maximum(1, n[mine] - 1)
        other = s / n
        other[np.arange(len(s)), mine] = np.inf
        b = other.min(1)
        out.append(np.where(n[mine] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)))
    return float(np.concatenate(out).mean())


def consensus_dissimilarity(run_labels: DataFrame, runs: int) -> DataFrame:
    """(i, j, dissimilarity), i < j, for cells that share a cluster in some run: 1 - runs together / runs. Noise is with nobody; pairs not listed are at 1.

    The pairs are the result here; a cluster's pairs meet by its key and are spread by the second cell as well.
    """
    a = run_labels.where("label <> -1")
    i, j = a.select("run_id", "label", F.col("cell_id").alias("i")), a.select("run_id", "label", F.col("cell_id").alias("j"))
    return i.join(j, ["run_id", "label"]).where("i < j").groupBy("i", "j").agg((F.lit(1.0) - F.count(F.lit(1)) / F.lit(float(runs))).alias("dissimilarity"))


def average_linkage(d: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of average linkage on a full distance matrix."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, live = list(range(n)), np.ones(n), np.ones(n, bool)
    near, out = d.argmin(1) if n else np.zeros(0, int), []
    for step in range(n - 1):
        low = np.where(live, d[np.arange(n), near], np.inf)
        i = int(low.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = sorted((name[i], name[j]))
        out.append((a, b, h, size[i] + size[j]))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j] = False
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        d[i, ~live], d[~live, i] = np.inf, np.inf
        name[i] = n + step
        stale = np.flatnonzero(live & ((near == i) | (near == j)))
        for r in {*stale.tolist(), i}:
            near[r] = d[r].argmin()
        better = live & (d[i] < d[np.arange(n), near])
        near[better] = i
    return np.array(out).reshape(-1, 4)


def cut_by_inconsistency(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Flat clusters: the largest subtrees in which no merge is more inconsistent (depth 2) than the threshold."""
    m = len(merges)
    worst = np.zeros(m)
    for k in range(m):
        heights = [merges[k, 2]] + [merges[int(c) - n, 2] for c in merges[k, :2] if c >= n]
        sd = np.std(heights, ddof=1) if len(heights) > 1 else 0.0
        mine = (merges[k, 2] - np.mean(heights)) / sd if sd > 0 else 0.0
        worst[k] = max([mine] + [worst[int(c) - n] for c in merges[k, :2] if c >= n])
    label, nxt = np.full(n, -1), 0
    stack = [n + m - 1] if m else list(range(n))
    while stack:
        node = stack.pop()
        if node < n:
            label[node], nxt = nxt, nxt + 1
        elif worst[node - n] <= threshold:
            todo = [node]
            while todo:
                k = todo.pop()
                if k < n:
                    label[k] = nxt
                else:
                    todo += [int(c) for c in merges[k - n, :2]]
            nxt += 1
        else:
            stack += [int(c) for c in merges[node - n, :2]]
    return label


def consensus_cluster(runs: DataFrame, run_labels: DataFrame, cells: DataFrame, silhouette_cutoff: float, inconsistent_value: float = 0.3, min_cluster_size: int = 10) -> DataFrame:
    """(cell_id, cluster): average linkage of the consensus of all runs at or above the cutoff, cut by inconsistency; clusters under the least size are -1, the others 1..K."""
    good = runs.where(F.col("silhouette") >= silhouette_cutoff).select("run_id")
    n_runs = good.count()
    if not n_runs:
        raise ValueError("no run reaches the silhouette cutoff")
    if cells.limit(SCAN_CELLS + 1).count() > SCAN_CELLS:
        raise ValueError(f"a consensus takes at most {SCAN_CELLS} cells")
    ids = [r[0] for r in cells.select("cell_id").orderBy("cell_id").collect()]
    at = {c: i for i, c in enumerate(ids)}
    d = np.ones((len(ids), len(ids)))
    np.fill_diagonal(d, 0)
    for r in consensus_dissimilarity(run_labels.join(good, "run_id", "left_semi"), n_runs).toLocalIterator():
        d[at[r["i"]], at[r["j"]]] = d[at[r["j"]], at[r["i"]]] = r["dissimilarity"]
    label = cut_by_inconsistency(average_linkage(d), len(ids), inconsistent_value)
    out = cells.sparkSession.createDataFrame(pd.DataFrame({"cell_id": ids, "cluster": label}), f"cell_id {cells.schema['cell_id'].dataType.simpleString()}, cluster int")
    return relabel(small_to_noise(out, min_cluster_size))


def small_to_noise(clusters: DataFrame, min_size: int) -> DataFrame:
    """Clusters with fewer than min_size cells become -1. Sizes are counted apart, so no cluster gathers in one task."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(size, "cluster").select("cell_id", F.when(F.col("n") < min_size, F.lit(-1)).otherwise(F.col("cluster")).cast("int").alias("cluster"))


def relabel(clusters: DataFrame) -> DataFrame:
    """Clusters other than -1 numbered 1..K in their order. Only the list of clusters is sorted."""
    names = clusters.where("cluster <> -1").select("cluster").distinct().withColumn("to", F.row_number().over(Window.orderBy("cluster")))
    return clusters.join(names, "cluster", "left").select("cell_id", F.coalesce("to", F.lit(-1)).cast("int").alias("cluster"))


def knn_codex(codex: DataFrame, k: int = 5) -> DataFrame:
    """Each imaging cell's k nearest by correlation, itself included."""
    return knn(codex, codex, k)
