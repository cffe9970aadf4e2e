"""Which features meet on neighbouring cells: adjacency scores, their null models and q-values.

The score of features f and g is the sum of f_i g_j over the edges (i, j) of the neighbour graph, taken in both
directions; with c > 0 the graph is replaced by the heat kernel (exp(c A) - I) / c, as a truncated series applied to
the features. This is the published form as far as it is described; it is kept in this module alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions.scalar import q_strength
from cellweft.operators.knn import spatial_knn
from cellweft.session import stored


def knn_graph(points: DataFrame, k: int, **options) -> DataFrame:
    """(i, j): both directions of the edges from each cell to its k nearest others, each once."""
    e = spatial_knn(points, k, **options).select(F.col("q").alias("i"), F.col("d").alias("j"))
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def all_pairs(features: DataFrame) -> DataFrame:
    """(f, g): all unordered pairs of features (feature), each with itself included, ordered as strings. The list of features is a list of names, not of rows."""
    a = features.select(F.col("feature").cast("string").alias("f")).distinct()
    return a.join(a.select(F.col("f").alias("g")), F.col("f") <= F.col("g"))


def _spread(edges: DataFrame, long: DataFrame) -> DataFrame:
    return edges.join(long, edges.j == long.cell_id).groupBy(F.col("i").alias("cell_id"), "feature").agg(F.sum("value").alias("value"))


def diffused(edges: DataFrame, long: DataFrame, c: float, terms: int = 6) -> DataFrame:
    """(cell_id, feature, value): the graph, or its heat kernel of width c, applied to the features."""
    step = _spread(edges, long)
    if c <= 0:
        return step
    out = step
    for n in range(2, terms + 1):
        step = stored(_spread(edges, step), "heat")
        out = out.unionByName(step.withColumn("value", F.col("value") * F.lit(c ** (n - 1) / math.factorial(n))))
    return out.groupBy("cell_id", "feature").agg(F.sum("value").alias("value"))


def adjacency_score(edges: DataFrame, long: DataFrame, pairs: DataFrame, c: float = 0.0) -> DataFrame:
    """(f, g, score) for each pair. long: (cell_id, feature, value), zeros may be left out. Neighbours are summed per feature before pairs meet."""
    long = long.select("cell_id", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double")).where("value <> 0")
    here = long.select("cell_id", F.col("feature").alias("f"), F.col("value").alias("x"))
    there = diffused(edges, long, c).select("cell_id", F.col("feature").alias("g"), F.col("value").alias("y"))
    met = here.join(F.broadcast(pairs), "f").join(there, ["cell_id", "g"]) if _few(pairs) else here.join(pairs, "f").join(there, ["cell_id", "g"])
    got = met.groupBy("f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return pairs.join(got, ["f", "g"], "left").select("f", "g", F.coalesce("score", F.lit(0.0)).alias("score"))


def _few(pairs: DataFrame) -> bool:
    return pairs.limit(50_001).count() <= 50_000


def cluster_score(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(f, g, score): edges between each pair of exclusive clusters, by counting label pairs; no matrix of members is made."""
    c = clusters.select("cell_id", F.col("cluster").cast("string").alias("cluster"))
    a, b = c.select(F.col("cell_id").alias("i"), F.col("cluster").alias("f")), c.select(F.col("cell_id").alias("j"), F.col("cluster").alias("g"))
    met = edges.join(a, "i").join(b, "j").groupBy("f", "g").agg(F.count(F.lit(1)).cast("double").alias("score"))
    pairs = all_pairs(c.select(F.col("cluster").alias("feature")))
    return pairs.join(met, ["f", "g"], "left").select("f", "g", F.coalesce("score", F.lit(0.0)).alias("score"))


def null_moments(edges: DataFrame, long: DataFrame, pairs: DataFrame, c: float = 0.0) -> DataFrame:
    """(f, g, score, mean, sd): the score, and the exact mean and deviation of its null over all ways of dealing f's values to the cells of the graph.

    The score is a product of two columns over n cells, so that both follow from sums: mean = sum x * sum y / n, and
    variance = (sum x^2 - (sum x)^2 / n) (sum y^2 - (sum y)^2 / n) / (n - 1). No deal is made.
    """
    long = long.select("cell_id", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double")).where("value <> 0")
    nodes = edges.select(F.col("i").alias("cell_id")).distinct()
    n = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = lambda df, name: df.groupBy(F.col("feature").alias(name)).agg(F.sum("value").alias(f"{name}1"), F.sum(F.col("value") * F.col("value")).alias(f"{name}2"))
    here, there = sums(long.join(nodes, "cell_id", "left_semi"), "f"), sums(diffused(edges, long, c), "g")
    full = adjacency_score(edges, long, pairs, c).join(here, "f", "left").join(there, "g", "left").join(F.broadcast(n)).na.fill(0.0, ["f1", "f2", "g1", "g2"])  # n is one row
    left = lambda x: F.greatest(F.col(f"{x}2") - F.col(f"{x}1") * F.col(f"{x}1") / F.col("n"), F.lit(0.0))
    return full.select("f", "g", "score", F.coalesce(F.try_divide(F.col("f1") * F.col("g1"), F.col("n")), F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(F.try_divide(left("f") * left("g"), F.col("n") - 1)), F.lit(0.0)).alias("sd"))


def permuted_scores(edges: DataFrame, long: DataFrame, pairs: DataFrame, c: float = 0.0, num_perms: int = 100, seed: int = 0) -> DataFrame:
    """(f, g, mean, sd, above): the score's null when f's values are dealt to other cells, from num_perms deals.

    A deal moves the values by one random rotation of a hashed order of the cells: a permutation that a join can
    make, alike when a task is repeated. There are only as many such deals as cells, and they are not independent.
    `above` counts the deals whose score reaches the observed one. For the moments alone use null_moments().
    """
    long = long.select("cell_id", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double")).where("value <> 0")
    nodes = edges.select(F.col("i").alias("cell_id")).distinct()
    order = stored(_numbered(nodes, seed), "order")
    n = order.count()
    there = stored(diffused(edges, long, c).select("cell_id", F.col("feature").alias("g"), F.col("value").alias("y")), "spread")
    placed = order.join(there, "cell_id").select(F.col("at").alias("to"), "g", "y")
    here = order.join(long, "cell_id").select("at", F.col("feature").alias("f"), F.col("value").alias("x"))
    turn = F.explode(F.sequence(F.lit(1), F.lit(num_perms)))
    # the shift of a deal depends on the deal and the feature alone
    dealt = here.withColumn("perm", turn).withColumn("to", F.pmod(F.col("at") + F.pmod(F.xxhash64(F.lit(seed), "perm", "f"), F.lit(max(1, n - 1))) + 1, F.lit(max(1, n))))
    scores = dealt.join(pairs, "f").join(placed, ["to", "g"]).groupBy("f", "g", "perm").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    seen = adjacency_score(edges, long, pairs, c)
    stats = scores.join(seen, ["f", "g"]).groupBy("f", "g").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum((F.col("s") >= F.col("score")).cast("int")).alias("above"), F.count(F.lit(1)).alias("seen"))
    mean = F.coalesce("s1", F.lit(0.0)) / num_perms
    var = (F.coalesce("s2", F.lit(0.0)) - mean * mean * num_perms) / max(1, num_perms - 1)
    full = seen.join(stats, ["f", "g"], "left")
    missing = F.when(F.col("score") <= 0, F.lit(num_perms) - F.coalesce("seen", F.lit(0))).otherwise(F.lit(0))
    return full.select("f", "g", "score", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), (F.coalesce("above", F.lit(0)) + missing).alias("above"))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its place, from 0, in the order of the keys, and the partition `_part` of that order; numbered through partition offsets, in no single task."""
    ranged = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "places")
    size = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    before = size.select("_part", "_first", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_b"))  # a row for each partition
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_b") + F.col("_at") - F.col("_first")).drop("_b", "_at", "_first")


def _numbered(nodes: DataFrame, seed: int) -> DataFrame:
    """(cell_id, at): places 0.. in a hashed order."""
    return numbered(nodes.withColumn("h", F.xxhash64(F.lit(seed), "cell_id")), ["h", "cell_id"], "at").select("cell_id", "at")


def upper_tail(x: pd.Series, mean: pd.Series, sd: pd.Series) -> np.ndarray:
    z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), np.where(x > mean, np.inf, 0.0))
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


def with_p_values(scores: DataFrame, num_perms: int = 0, estimate: bool = True) -> DataFrame:
    """Adds p: the normal tail of the null (mean, sd), or the share of num_perms deals that reach the score (above)."""
    if not estimate:
        return scores.withColumn("p", (F.col("above") + 1) / F.lit(num_perms + 1))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p"] = upper_tail(b["score"], b["mean"], b["sd"])
            yield b

    return scores.mapInPandas(tail, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.schema.fields) + ", p double")


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(x: int, population: int, marked: int, drawn: int) -> float:
    """P(X >= x) for a draw without replacement. Terms are built up from the first by their ratios and end 45 deviations past the mode, where nothing is left."""
    lo, hi = max(x, drawn - (population - marked), 0), min(marked, drawn)
    if lo > hi:
        return 0.0
    share = marked / population if population else 0.0
    mode, sd = drawn * share, math.sqrt(max(1.0, drawn * share * (1 - share)))
    lo_sum = lo
    if lo < mode - 45 * sd:
        return 1.0
    hi = min(hi, int(max(lo, mode) + 45 * sd + 50))
    first = _log_choose(marked, lo_sum) + _log_choose(population - marked, drawn - lo_sum) - _log_choose(population, drawn)
    k = np.arange(lo_sum, hi, dtype=float)
    ratio = np.log((marked - k) * (drawn - k)) - np.log((k + 1) * (population - marked - drawn + k + 1))
    terms = first + np.concatenate([[0.0], np.cumsum(ratio)])
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def cluster_p_values(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(f, g, score, p): cluster_score() with a hypergeometric null: of all ordered pairs of cells, those in (f, g), drawn as often as there are edges."""
    scores = cluster_score(edges, clusters)
    size = clusters.groupBy(F.col("cluster").cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = size.agg(F.sum("n").alias("cells"))
    drawn = edges.agg(F.count(F.lit(1)).alias("drawn"))
    full = (
        scores.join(size.select(F.col("c").alias("f"), F.col("n").alias("nf")), "f").join(size.select(F.col("c").alias("g"), F.col("n").alias("ng")), "g")
        .join(F.broadcast(total)).join(F.broadcast(drawn))
        .select("f", "g", "score", (F.col("cells") * (F.col("cells") - 1)).alias("population"), (F.col("nf") * (F.col("ng") - (F.col("f") == F.col("g")).cast("int"))).alias("marked"), "drawn")
    )

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [hypergeometric_tail(int(r.score), int(r.population), int(r.marked), int(r.drawn)) for r in b.itertuples()]
            yield pd.DataFrame({"f": b["f"], "g": b["g"], "score": b["score"], "p": p})

    return full.mapInPandas(tail, "f string, g string, score double, p double")


def with_q_values(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds q by Benjamini and Hochberg: the least p * m / rank of all at or above a rank.

    Rows are ranked through partition offsets; the least value of later partitions is carried to the earlier ones.
    Rows with a null or NaN p have a null q; they count as rows.
    """
    names = df.columns
    placed = stored(numbered(df.withColumn("_ok", F.col(p).isNotNull() & ~F.isnan(p)).withColumn("_p", F.when(F.col("_ok"), F.col(p)).otherwise(F.lit(float("inf")))), ["_p", "f", "g"], "_r"), "ranked")
    m = placed.agg(F.count(F.lit(1)).alias("_m"))
    raw = placed.join(F.broadcast(m)).withColumn("_a", F.col("_p") * F.col("_m") / (F.col("_r") + 1))
    later = raw.groupBy("_part").agg(F.min("_a").alias("_l"))
    after = later.select("_part", F.min("_l").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))  # a row for each partition
    inside = F.min("_a").over(Window.partitionBy("_part").orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn("_in", inside).join(F.broadcast(after), "_part").select(*names, F.when(F.col("_ok"), F.least(F.lit(1.0), F.col("_in"), F.coalesce("_after", F.lit(float("inf"))))).otherwise(F.lit(None).cast("double")).alias("q"))


def heatmap(scores: DataFrame, features: list[str], scaling: float = 1e-10) -> DataFrame:
    """One row per f and one column per feature: -log10(q + scaling), symmetric."""
    s = scores.select("f", "g", q_strength(F.col("q"), scaling).alias("v"))
    both = s.unionByName(s.select(F.col("g").alias("f"), F.col("f").alias("g"), "v"))
    return both.groupBy("f").pivot("g", features).agg(F.max("v"))
