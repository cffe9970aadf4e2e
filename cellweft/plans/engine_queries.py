"""Queries of the single-cell operators on the project's tables, each with the SQL that gives the same rows.

Roles: reference cells are the usable vectors of cite_latent; imaging cells are the vectors of embeddings, their first
20 elements the features that both sides share; positions are the cells of codex_spatial, slides laid side by side;
counts of transcripts are quantities of lineitem by supplier and part, of proteins the events by user and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft import frames
from cellweft.functions import scalar
from cellweft.operators import adjacency, anchors, clustering, embedding, mapping, mixtures, qc, transfer, views
from cellweft.operators.knn import closest_points, find_nn, knn
from cellweft.operators.knn import spatial_knn as _spatial_knn
from cellweft.plans.spatial_queries import positions_nm
from cellweft.session import parse_cluster, stored, table, usable_vector
from cellweft.sources.fcs import tile_to_absolute

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHARED, SLIDE_STEP = 20, 1e7
FIXED = {"size_lim": (1000.0, 25000.0), "blank_upper": (6000.0, 2500.0, 5000.0, 2500.0), "blank_lower": (-1200.0,) * 4}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Inputs


def gate_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "codex_gate").select("row_id", "cell_id", F.col("codex_size").alias("size"), F.col("codex_blanks").alias("blanks"))


def cite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cite_latent").where(usable_vector("cite_latent", SHARED)).select("cell_id", F.col("cite_latent").alias("vec")).distinct()


def imaging(spark: SparkSession, d: str, dims: int | None = SHARED) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.slice(v, 1, dims) if dims else v).alias("vec"))


def imaging_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("cluster"))


def cite_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cite_clusters").select("cell_id", parse_cluster("cluster_label").cast("string").alias("cluster")).where("cluster IS NOT NULL AND cell_id IS NOT NULL").groupBy("cell_id").agg(F.min("cluster").alias("cluster"))


def codex_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "codex_clusters").select("cell_id", parse_cluster("cluster_label").cast("string").alias("cluster")).where("cluster IS NOT NULL AND cell_id IS NOT NULL").groupBy("cell_id").agg(F.min("cluster").alias("cluster"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, x, y, z) in nm: each cell once, at the least of its positions, slides next to one another."""
    p = positions_nm(spark, d).where("cell_id IS NOT NULL")
    first = p.groupBy("cell_id").agg(F.min(F.struct("slide_id", "x", "y", "z")).alias("p"))
    slides = p.select("slide_id").distinct().withColumn("nr", F.row_number().over(Window.orderBy("slide_id")))  # a row for each slide
    return first.select("cell_id", "p.*").join(F.broadcast(slides), "slide_id").select("cell_id", (F.col("x") + F.col("nr") * F.lit(SLIDE_STEP)).alias("x"), "y", "z")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def cite_expression(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, feature, value): the positive part of the latent vectors, in the place of transcripts."""
    return frames.to_long(cite(spark, d)).where("value > 0")


_CITE = "cite AS (SELECT DISTINCT cell_id AS id, cite_latent AS v FROM cite_latent WHERE len(cite_latent) = 20 AND len(list_filter(cite_latent, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max(cite_latent) > list_min(cite_latent))"
_EMB = "emb AS (SELECT vec_id AS id, list_transform(embedding[1:20], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_FULL = "emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_NUM = r"TRY_CAST(nullif(regexp_extract(cluster_label, '(?i)^\s*(?:cluster[_\s]?|c[_\s]?)?(-?\d+)(?:\.0*)?\s*$', 1), '') AS BIGINT)"
_CITE_LAB = f"lab AS (SELECT cell_id, min(CAST({_NUM} AS VARCHAR)) AS cluster FROM cite_clusters WHERE {_NUM} IS NOT NULL AND cell_id IS NOT NULL GROUP BY 1)"
_CODEX_LAB = f"lab AS (SELECT cell_id, min(CAST({_NUM} AS VARCHAR)) AS cluster FROM codex_clusters WHERE {_NUM} IS NOT NULL AND cell_id IS NOT NULL GROUP BY 1)"
_TX = "tx AS (SELECT l_suppkey AS cell_id, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
_PR = "pr AS (SELECT user_id AS cell_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"
_RNA = "rna AS (SELECT id AS cell_id, i AS feature, v[i] AS value FROM (SELECT id, v, unnest(range(1, 21)) AS i FROM cite) WHERE v[i] > 0)"
_POS = """raw AS (SELECT cell_id, slide_id, x * CASE WHEN coord_unit = 'voxel' THEN 188.0 ELSE 1.0 END AS x, y * CASE WHEN coord_unit = 'voxel' THEN 188.0 ELSE 1.0 END AS y,
  z * CASE WHEN coord_unit = 'voxel' THEN 900.0 ELSE 1.0 END AS z FROM codex_spatial WHERE slide_id IS NOT NULL AND cell_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
  AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
slides AS (SELECT slide_id, row_number() OVER (ORDER BY slide_id) AS nr FROM (SELECT DISTINCT slide_id FROM raw)),
pos AS (SELECT cell_id, slide_id, x + nr * 1e7 AS x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY slide_id, x, y, z) AS rn FROM raw) JOIN slides USING (slide_id) WHERE rn = 1)"""
_GRAPH = """near AS (SELECT a.cell_id AS q, b.cell_id AS d, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS dist
  FROM pos a JOIN pos b ON a.slide_id = b.slide_id AND a.cell_id <> b.cell_id),
spat AS (SELECT q, d, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, d) AS INTEGER) AS rank, dist FROM near QUALIFY rank <= 3),
edges AS (SELECT q AS i, d AS j FROM spat UNION SELECT d, q FROM spat)"""


def nn_sql(name: str, data: str, ask: str, k: int, metric: str = "correlation") -> str:
    """Text of the tables {name} (q, d, rank, dist) with the k nearest rows of `data` (id, v) for each row of `ask`."""
    if metric == "euclidean":
        dist = "round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9)"
        return f"{name} AS (SELECT q, d, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, d) AS INTEGER) AS rank, dist FROM (SELECT a.id AS q, b.id AS d, {dist} AS dist FROM {ask} a, {data} b) QUALIFY rank <= {k})"
    unit = lambda t: f"(SELECT id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM (SELECT id, list_transform(v, lambda x: x - m) AS c FROM (SELECT id, v, list_avg(v) AS m FROM {t})))"
    return f"{name} AS (SELECT q, d, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, d) AS INTEGER) AS rank, dist FROM (SELECT a.id AS q, b.id AS d, round(1 - list_dot_product(a.u, b.u), 9) AS dist FROM {unit(ask)} a, {unit(data)} b) QUALIFY rank <= {k})"


# Quality control

_CELLS = """g AS (SELECT row_id, cell_id, codex_size AS size, codex_blanks AS b FROM codex_gate),
bl AS (SELECT i, quantile_cont(v, 0.002) AS lo, quantile_cont(v, 0.995) AS hi FROM (SELECT unnest([1, 2, 3, 4]) AS i, unnest([b[1], b[2], b[3], b[4]]) AS v FROM g) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1),
bound AS (SELECT list(lo ORDER BY i) AS lower, list(hi ORDER BY i) AS upper, (SELECT quantile_cont(size, 0.025) FROM g WHERE NOT isnan(size)) AS slo, (SELECT quantile_cont(size, 0.99) FROM g WHERE NOT isnan(size)) AS shi FROM bl)"""
_PASS = """size IS NOT NULL AND NOT isnan(size) AND size BETWEEN slo AND shi AND len(b) >= 4 AND len(list_filter(b[1:4], lambda x: x IS NULL OR isnan(x))) = 0
AND (b[1] >= lower[1] OR b[2] >= lower[2] OR b[3] >= lower[3] OR b[4] >= lower[4]) AND b[1] <= upper[1] AND b[2] <= upper[2] AND b[3] <= upper[3] AND b[4] <= upper[4]"""


@query(f"WITH {_CELLS} SELECT row_id, cell_id, size FROM g, bound WHERE {_PASS}")
def gate_quantile_default(spark, d):
    return qc.gate(gate_cells(spark, d), 4).select("row_id", "cell_id", "size")


@query(f"""WITH g AS (SELECT row_id, cell_id, codex_size AS size, codex_blanks AS b FROM codex_gate),
bound AS (SELECT 1000.0 AS slo, 25000.0 AS shi, [-1200.0, -1200.0, -1200.0, -1200.0] AS lower, [6000.0, 2500.0, 5000.0, 2500.0] AS upper) SELECT row_id, cell_id, size FROM g, bound WHERE {_PASS}""")
def gate_fixed_bounds(spark, d):
    return qc.gate(gate_cells(spark, d), 4, **FIXED).select("row_id", "cell_id", "size")


@query(f"""WITH {_TX}, c AS (SELECT cell_id FROM tx GROUP BY 1 HAVING sum(value) >= 1200), k AS (SELECT * FROM tx SEMI JOIN c USING (cell_id)),
f AS (SELECT feature FROM k WHERE value <> 0 GROUP BY 1 HAVING count(*) >= 30) SELECT cell_id, feature, value FROM k SEMI JOIN f USING (feature)""")
def filter_counts_cells_genes(spark, d):
    return qc.filter_counts(transcripts(spark, d), 1200, 30)


@query("SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def dedupe_first_wins(spark, d):
    return qc.first_wins(table(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS place FROM (SELECT DISTINCT lower(trim(source)) AS feature FROM mix_targets) WHERE feature IN (SELECT lower(trim(source)) FROM documents WHERE source IS NOT NULL)")
def common_features(spark, d):
    names = lambda t: sorted(r[0] for r in table(spark, d, t).where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("s")).distinct().collect())
    both = qc.common_features(names("mix_targets"), names("documents"))
    return spark.createDataFrame([(f, i) for i, f in enumerate(both)], "feature string, place bigint")


@query("SELECT event_type AS channel, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, '^(view|click)') GROUP BY 1")
def drop_channels(spark, d):
    return qc.drop_channels(table(spark, d, "events"), "event_type", "^(view|click)").groupBy(F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT regexp_replace(c_name, '^Customer#', '') AS name FROM customer")
def strip_prefix(spark, d):
    return qc.strip_prefix(table(spark, d, "customer").select(F.col("c_name").alias("name")), "name", "Customer#")


@query(f"WITH {_POS} SELECT cell_id, x - mx + 1 AS x, y - my + 1 AS y FROM pos, (SELECT min(x) AS mx, min(y) AS my FROM pos) WHERE x - mx + 1 < 2e6 AND y - my + 1 < 9e5")
def spatial_window(spark, d):
    p = positions(spark, d)
    low = F.broadcast(p.agg(F.min("x").alias("mx"), F.min("y").alias("my")))
    return qc.window(p.join(low).select("cell_id", (F.col("x") - F.col("mx") + 1).alias("x"), (F.col("y") - F.col("my") + 1).alias("y")), 2e6, 9e5)


# Normalisation


@query(f"WITH {_PR} SELECT cell_id, feature, round(value / sum(value) OVER (PARTITION BY cell_id), 6) AS value FROM pr")
def norm_cells(spark, d):
    return mixtures.normalise_cells(proteins(spark, d)).withColumn("value", r6("value"))


@query(f"WITH {_PR}, t AS (SELECT cell_id, sum(value * value) AS t FROM pr GROUP BY 1) SELECT cell_id, feature, round(value / t, 6) AS value FROM pr JOIN t USING (cell_id)")
def norm_cells_by_raw(spark, d):
    p = proteins(spark, d)
    return mixtures.normalise_cells(p, p.withColumn("value", F.col("value") * F.col("value"))).withColumn("value", r6("value"))


@query(f"WITH {_PR} SELECT cell_id, feature, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM pr")
def log_normalize(spark, d):
    return mixtures.normalise_cells(proteins(spark, d)).withColumn("value", r6(F.log1p(F.lit(1e4) * F.col("value"))))


@query(f"""WITH {_CITE}, p AS (SELECT id, [greatest(x, 0.0) for x in v] AS v FROM cite) SELECT id AS cell_id, list_transform(v, lambda x: round(ln(1 + 1e4 * x / list_sum(v)), 6)) AS vec FROM p""")
def log_normalize_vectors(spark, d):
    positive = cite(spark, d).select("cell_id", F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec"))
    return positive.select("cell_id", F.transform(scalar.log_normalise(F.col("vec")), r6).alias("vec"))


_LONG = "l AS (SELECT id AS cell_id, i AS feature, v[i] AS value FROM (SELECT id, v, unnest(range(1, 21)) AS i FROM cite))"


@query(f"""WITH {_CITE}, {_LONG}, m AS (SELECT *, value - (SELECT min(value) FROM l) AS s FROM l), t AS (SELECT cell_id, sum(s) AS t FROM m GROUP BY 1)
SELECT cell_id, CAST(feature AS INTEGER) AS feature, round(CASE WHEN t = 0 THEN s ELSE s / t END * (SELECT avg(t) FROM t), 6) AS value FROM m JOIN t USING (cell_id)""")
def shift_rescale_totals(spark, d):
    return mixtures.shift_rescale(frames.to_long(cite(spark, d))).withColumn("value", r6("value"))


@query(f"WITH {_PR}, a AS (SELECT cell_id, feature, asinh(value / 5) AS v FROM pr) SELECT cell_id, feature, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS value FROM a WINDOW w AS (PARTITION BY feature)")
def arcsinh_minmax(spark, d):
    return mixtures.arcsinh_min_max(proteins(spark, d)).withColumn("value", r6("value"))


@query(f"WITH {_EMB} SELECT id AS cell_id, list_transform(v, lambda x: round((x - list_avg(v)) / list_stddev_samp(v), 6)) AS vec FROM emb")
def standardize_per_cell(spark, d):
    return imaging(spark, d).select("cell_id", F.transform(scalar.standardise(F.col("vec")), r6).alias("vec"))


@query(f"WITH {_EMB} SELECT id AS cell_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS vec FROM emb")
def l2_normalize(spark, d):
    return imaging(spark, d).select("cell_id", F.transform(scalar.l2_normalise(F.col("vec")), r6).alias("vec"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN hi > lo THEN least(100, greatest(1, ceil(round((l_quantity - lo) / (hi - lo) * 100, 9)))) ELSE 50 END AS INTEGER) AS bin
FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)""")
def expression_bins(spark, d):
    li = table(spark, d, "lineitem")
    ends = F.broadcast(li.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")))
    return li.join(ends).select("l_orderkey", "l_linenumber", scalar.bins(F.col("l_quantity"), F.col("lo"), F.col("hi")).alias("bin"))


# Mixtures


@query(f"""WITH {_PR}, n AS (SELECT feature, CAST(value AS BIGINT) AS c, count(*) AS n FROM pr GROUP BY 1, 2), s AS (SELECT feature, max(c) AS m, sum(n) AS t FROM n GROUP BY 1),
g AS (SELECT feature, t, unnest(range(0, m + 1)) AS c FROM s) SELECT g.feature, g.c AS count, round(coalesce(n.n, 0) / g.t, 9) AS p FROM g LEFT JOIN n ON g.feature = n.feature AND g.c = n.c""")
def count_histogram(spark, d):
    return mixtures.count_histogram(proteins(spark, d)).withColumn("p", F.round("p", 9))


_NB = "exp(lgamma(c + 1 / {d}) - lgamma(1 / {d}) - lgamma(c + 1) + (1 / {d}) * ln((1 / {d}) / (1 / {d} + {m})) + c * ln({m} / (1 / {d} + {m})))"


@query(f"""WITH {_PR}, n AS (SELECT feature, CAST(value AS BIGINT) AS c, count(*) AS n FROM pr GROUP BY 1, 2), s AS (SELECT feature, max(c) AS m, sum(n) AS t FROM n GROUP BY 1),
g AS (SELECT feature, t, unnest(range(0, m + 1)) AS c FROM s), o AS (SELECT g.feature, g.c, coalesce(n.n, 0) / g.t AS p FROM g LEFT JOIN n ON g.feature = n.feature AND g.c = n.c)
SELECT feature, round(sum((p - (0.5 * {_NB.format(d='2.0', m='5.0')} + 0.5 * {_NB.format(d='0.5', m='50.0')})) ** 2), 9) AS sse FROM o GROUP BY 1""")
def nb_sse_fixed_params(spark, d):
    hist = mixtures.count_histogram(proteins(spark, d))
    fit = lambda g: __import__("pandas").DataFrame([{"feature": g["feature"].iloc[0], "sse": round(mixtures.nb_mix_sse((5.0, 50.0, 2.0, 0.5, 0.5), g.sort_values("count")["p"].to_numpy()), 9)}])
    return hist.groupBy("feature").applyInPandas(fit, "feature string, sse double")


@query(f"""WITH {_PR}, s AS (SELECT feature, max(CAST(value AS BIGINT)) AS m FROM pr GROUP BY 1), g AS (SELECT feature, unnest(range(0, m + 1)) AS c FROM s)
SELECT feature, c AS count, round(least(1.0, sum({_NB.format(d='0.5', m='12.0')}) OVER (PARTITION BY feature ORDER BY c)), 6) AS cdf FROM g""")
def nb_cdf_fixed_params(spark, d):
    top = proteins(spark, d).groupBy("feature").agg(F.max("value").cast("bigint").alias("top"))
    fits = top.select("feature", F.lit(12.0).alias("mu"), F.lit(0.5).alias("disp"))
    return mixtures.nb_cdf_table(fits, top).withColumn("cdf", r6("cdf"))


@query(f"WITH {_PR} SELECT cell_id, feature, round({scalar.normal_cdf_sql('value', '10.0', '3.0')}, 6) AS value FROM pr")
def gaussian_clean_fixed_params(spark, d):
    p = proteins(spark, d)
    fits = p.select("feature").distinct().select("feature", F.lit(10.0).alias("mu"), F.lit(3.0).alias("sd"))
    return mixtures.apply_gaussians(p, fits).withColumn("value", r6("value"))


@query()
def clean_cite_nb(spark, d):
    return mixtures.clean_cite(proteins(spark, d), "nb")


@query()
def clean_cite_gaussian(spark, d):
    return mixtures.clean_cite(proteins(spark, d), "gaussian")


@query()
def clean_codex_gaussian(spark, d):
    whole = table(spark, d, "codex_clean").where(usable_vector("codex_clean", 30)).groupBy("cell_id").agg(F.min("codex_clean").alias("vec"))
    return mixtures.clean_codex(stored(frames.to_long(whole), "long"), "gaussian")


@query()
def clean_codex_nb(spark, d):
    return mixtures.clean_codex(proteins(spark, d), "nb", normalize=True)


# Positions and neighbours


@query("""SELECT row_id, round(floor((tile_nr - 1) / 9) * mx + x, 4) AS x, round((((tile_nr - 1) % 9) + 9) % 9 * my + y, 4) AS y FROM
(SELECT row_id, tile_nr, x, y FROM codex_spatial WHERE tile_nr IS NOT NULL AND coord_unit = 'voxel' AND NOT isnan(x) AND NOT isnan(y)),
(SELECT max(x) AS mx, max(y) AS my FROM codex_spatial WHERE tile_nr IS NOT NULL AND coord_unit = 'voxel' AND NOT isnan(x) AND NOT isnan(y))""")
def tile_to_absolute_positions(spark, d):
    raw = table(spark, d, "codex_spatial").where("tile_nr IS NOT NULL AND coord_unit = 'voxel' AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("row_id", "tile_nr", "x", "y")
    return tile_to_absolute(raw, 9).select("row_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {_FULL}, {nn_sql('n', 'emb', 'emb', 20)} SELECT q, d, rank, round(dist, 6) AS dist FROM n")
def knn_correlation(spark, d):
    e = imaging(spark, d, None)
    return knn(e, e, 20).withColumn("dist", r6("dist"))


@query(f"WITH {_FULL}, {nn_sql('n', 'emb', 'emb', 20, 'euclidean')} SELECT q, d, rank, round(dist, 6) AS dist FROM n")
def knn_euclidean(spark, d):
    e = imaging(spark, d, None)
    return knn(e, e, 20, metric="euclidean").withColumn("dist", r6("dist"))


@query(f"WITH {_EMB}, {_CITE}, {nn_sql('a', 'emb', 'emb', 6, 'euclidean')}, {nn_sql('b', 'cite', 'emb', 5, 'euclidean')} SELECT 'qq' AS kind, CAST(q AS VARCHAR) AS q, CAST(d AS VARCHAR) AS d, rank, round(dist, 6) AS dist FROM a UNION ALL SELECT 'rq', CAST(q AS VARCHAR), d, rank, round(dist, 6) FROM b")
def find_nn_tables(spark, d):
    nn = find_nn(imaging(spark, d), cite(spark, d), 5)
    part = lambda k, t: t.select(F.lit(k).alias("kind"), F.col("q").cast("string").alias("q"), F.col("d").cast("string").alias("d"), "rank", r6("dist").alias("dist"))
    return part("qq", nn["rr"]).unionByName(part("rq", nn["rq"]))


@query(f"WITH {_POS}, {_GRAPH} SELECT q, d, rank, round(dist, 4) AS dist FROM spat")
def knn_spatial_graph(spark, d):
    return _spatial_knn(positions(spark, d), 3).withColumn("dist", F.round("dist", 4))


@query(f"WITH {_POS} SELECT cell_id, round(dist, 4) AS dist FROM (SELECT cell_id, sqrt((x - 1.001e7) * (x - 1.001e7) + (y - 2e4) * (y - 2e4)) AS dist FROM pos) WHERE dist < 1e6 ORDER BY dist, cell_id LIMIT 10")
def closest_point(spark, d):
    return closest_points(positions(spark, d), 1.001e7, 2e4, 10, 1e6).withColumn("dist", F.round("dist", 4))


# Transfer

_T = f"WITH {_EMB}, {_CITE}, {nn_sql('n', 'emb', 'cite', 5)}, t AS (SELECT d AS codex_id, q AS cite_id, exp(-dist / 0.1) / sum(exp(-dist / 0.1)) OVER (PARTITION BY q) AS weight FROM n)"


def _transfer(spark, d):
    return transfer.transfer_matrix(cite(spark, d), imaging(spark, d), 5, 0.1)


@query(f"{_T} SELECT codex_id, cite_id, round(weight, 6) AS weight FROM t")
def transfer_matrix_corr(spark, d):
    return _transfer(spark, d).withColumn("weight", r6("weight"))


@query(f"{_T}, {_RNA}, s AS (SELECT cell_id, feature, value / sum(value) OVER (PARTITION BY cell_id) AS share FROM rna) SELECT codex_id AS cell_id, CAST(feature AS INTEGER) AS feature, round(sum(weight * share), 6) AS value FROM t JOIN s ON cite_id = cell_id GROUP BY 1, 2")
def transfer_rna(spark, d):
    return transfer.transfer_features(_transfer(spark, d), cite_expression(spark, d)).withColumn("value", r6("value"))


@query(f"""{_T}, {_CITE_LAB}, s AS (SELECT codex_id, cluster, sum(weight) AS w FROM t JOIN lab ON cite_id = cell_id GROUP BY 1, 2),
b AS (SELECT codex_id, CASE WHEN w > 0 THEN cluster ELSE '-1' END AS cluster FROM s QUALIFY row_number() OVER (PARTITION BY codex_id ORDER BY round(w, 12) DESC, cluster) = 1)
SELECT id AS cell_id, coalesce(cluster, '-1') AS cluster FROM emb LEFT JOIN b ON id = codex_id""")
def transfer_clusters_argmax(spark, d):
    return transfer.transfer_clusters(_transfer(spark, d), cite_labels(spark, d), imaging(spark, d))


@query(f"""WITH {_EMB}, {_CITE}, {_CITE_LAB}, {nn_sql('n', 'cite', 'emb', 10, 'euclidean')}, v AS (SELECT q, cluster, sum(1 / greatest(dist, 1e-9)) AS v FROM n JOIN lab ON d = cell_id GROUP BY 1, 2)
SELECT q AS cell_id, cluster FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(v, 9) DESC, cluster) = 1""")
def fastknn_vote(spark, d):
    return transfer.neighbour_vote(cite(spark, d), imaging(spark, d), cite_labels(spark, d), 10)


@query(f"{_T}, {_CITE_LAB} SELECT codex_id AS cell_id, round(sum(weight), 6) AS value FROM t WHERE cite_id IN (SELECT cell_id FROM lab WHERE cluster = '3') GROUP BY 1")
def selected_cell_projection(spark, d):
    return transfer.selected_cells(_transfer(spark, d), cite_labels(spark, d).where("cluster = '3'")).withColumn("value", r6("value"))


@query(f"{_T}, {_RNA} SELECT codex_id AS cell_id, round(ln(1 + 1000 * sum(weight * value)), 6) AS value FROM t JOIN rna ON cite_id = cell_id WHERE feature = 1 GROUP BY 1")
def single_gene_projection(spark, d):
    return transfer.one_feature(_transfer(spark, d), cite_expression(spark, d), 1).withColumn("value", r6(F.log1p(F.lit(1000.0) * F.col("value"))))


# Anchors: neighbour tables by correlation on the shared features, so that SQL can give the same

_NN = f"{_EMB}, {_CITE}, {nn_sql('rq', 'emb', 'cite', 20)}, {nn_sql('qr', 'cite', 'emb', 20)}"
_MNN = "mnn AS (SELECT rq.q AS r, rq.d AS q FROM rq JOIN qr ON rq.q = qr.d AND rq.d = qr.q)"
_FIL = f"{nn_sql('eq', 'emb', 'cite', 10, 'euclidean')}, {nn_sql('er', 'cite', 'emb', 10, 'euclidean')}, fil AS (SELECT r, q FROM mnn WHERE (r, q) IN (SELECT (q, d) FROM eq) OR (r, q) IN (SELECT (d, q) FROM er))"
_SNN = f"""{nn_sql('rr', 'cite', 'cite', 21)}, {nn_sql('qq', 'emb', 'emb', 21)},
e AS (SELECT 'r' AS si, CAST(q AS VARCHAR) AS i, 'r' AS sj, CAST(d AS VARCHAR) AS j FROM rr WHERE rank <= 20 UNION ALL SELECT 'r', CAST(q AS VARCHAR), 'q', CAST(d AS VARCHAR) FROM rq
 UNION ALL SELECT 'q', CAST(q AS VARCHAR), 'r', CAST(d AS VARCHAR) FROM qr UNION ALL SELECT 'q', CAST(q AS VARCHAR), 'q', CAST(d AS VARCHAR) FROM qq WHERE rank <= 20),
cnt AS (SELECT m.r, m.q, count(b.j) AS n FROM mnn m LEFT JOIN e a ON a.si = 'r' AND a.i = CAST(m.r AS VARCHAR) LEFT JOIN e b ON b.si = 'q' AND b.i = CAST(m.q AS VARCHAR) AND b.sj = a.sj AND b.j = a.j GROUP BY 1, 2),
bd AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(n AS DOUBLE), 0.9) AS hi FROM cnt),
sc AS (SELECT r, q, CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (n - lo) / (hi - lo))) ELSE 0.0 END AS score FROM cnt, bd)"""


def _nn(spark, d, k=20, full=False):
    """The neighbour tables. Only a reference cell near some imaging cell can be in an anchor, so the others ask for nothing."""
    r, q = stored(cite(spark, d), "cite"), imaging(spark, d)
    qr = stored(knn(r, q, k), "nn")
    near = r.join(qr.select(F.col("d").alias("cell_id")).distinct(), "cell_id", "left_semi")
    nn = {"rq": knn(q, near, k), "qr": qr}
    if full:
        nn |= {"rr": knn(r, near, k + 1), "qq": knn(q, q, k + 1)}
    return {n: t if n == "qr" else stored(t, "nn") for n, t in nn.items()}


def _anchors(spark, d):
    nn = _nn(spark, d)
    return anchors.anchor_pairs(nn["rq"], nn["qr"], 20)


@query(f"WITH {_NN}, {_MNN} SELECT r, q, 1.0 AS score FROM mnn".replace("1.0 AS score", "CAST(1.0 AS DOUBLE) AS score"))
def anchors_mnn(spark, d):
    return _anchors(spark, d)


@query(f"WITH {_NN}, {_MNN}, {_FIL} SELECT r, q FROM fil")
def anchors_filtered(spark, d):
    r, q = cite(spark, d), imaging(spark, d)
    return anchors.filter_anchors(_anchors(spark, d), knn(q, r, 10, metric="euclidean"), knn(r, q, 10, metric="euclidean"), 10).select("r", "q")


def _scored(spark, d):
    nn = _nn(spark, d, 20, True)
    return anchors.score_anchors(anchors.anchor_pairs(nn["rq"], nn["qr"], 20), nn, 20)


@query(f"WITH {_NN}, {_MNN}, {_SNN} SELECT r, q, round(score, 6) AS score FROM sc")
def anchors_scored_snn(spark, d):
    return _scored(spark, d).withColumn("score", r6("score"))


_VEC = "iv AS (SELECT s.r, s.q, s.score, list_transform(list_zip(b.v, a.v), lambda p: p[1] - p[2]) AS vec FROM sc s JOIN cite a ON a.id = s.r JOIN emb b ON b.id = s.q)"


@query(f"WITH {_NN}, {_MNN}, {_SNN}, {_VEC} SELECT r, q, round(score, 6) AS score, list_transform(vec, lambda x: round(x, 6)) AS vec FROM iv")
def integration_vectors(spark, d):
    v = anchors.integration_vectors(stored(_scored(spark, d), "anchors"), cite(spark, d), imaging(spark, d))
    return v.select("r", "q", r6("score").alias("score"), F.transform("vec", r6).alias("vec"))


_K = 50
_WGT = f"""{nn_sql('aq', '(SELECT DISTINCT id, v FROM emb SEMI JOIN sc ON sc.q = emb.id)', 'emb', 100000)},
arow AS (SELECT aq.q AS cell, aq.d AS aq, aq.dist, row_number() OVER (PARTITION BY aq.q ORDER BY aq.rank, s.r) AS rn FROM aq JOIN sc s ON s.q = aq.d),
kept AS (SELECT cell, aq, dist, max(dist) OVER (PARTITION BY cell) AS last FROM arow WHERE rn <= {_K + 1} AND rn >= 2),
wq AS (SELECT cell, aq, max(CASE WHEN last > 0 THEN 1 - dist / last ELSE 0 END) AS w FROM kept GROUP BY 1, 2),
ur AS (SELECT cell, s.r, s.q, 1 - exp(-(w * s.score) / 4) AS u FROM wq JOIN sc s ON s.q = wq.aq),
wt AS (SELECT cell AS cell_id, r, q, u / t AS weight FROM (SELECT *, sum(u) OVER (PARTITION BY cell) AS t FROM ur) WHERE t > 0)"""


@query(f"WITH {_NN}, {_MNN}, {_SNN}, {_WGT} SELECT cell_id, r, q, round(weight, 6) AS weight FROM wt")
def anchor_weights(spark, d):
    return anchors.anchor_weights(stored(_scored(spark, d), "anchors"), imaging(spark, d), _K).withColumn("weight", r6("weight"))


@query(f"""WITH {_NN}, {_MNN}, {_SNN}, {_VEC}, {_WGT}, mv AS (SELECT cell_id, i, sum(weight * vec[i]) AS s FROM (SELECT w.cell_id, w.weight, v.vec, unnest(range(1, 21)) AS i FROM wt w JOIN iv v ON w.r = v.r AND w.q = v.q) GROUP BY 1, 2),
sh AS (SELECT cell_id, list(s ORDER BY i) AS s FROM mv GROUP BY 1)
SELECT id AS cell_id, list_transform(list_zip(v, coalesce(s, list_transform(v, lambda x: 0.0))), lambda p: round(p[1] - p[2], 5)) AS vec FROM emb LEFT JOIN sh ON id = cell_id""")
def anchor_corrected(spark, d):
    scored = stored(_scored(spark, d), "anchors")
    r, q = cite(spark, d), imaging(spark, d)
    out = anchors.apply_correction(q, anchors.integration_vectors(scored, r, q), anchors.anchor_weights(scored, q, _K))
    return out.select("cell_id", F.transform("vec", lambda x: F.round(x, 5)).alias("vec"))


@query()
def cca_embedding(spark, d):
    r, q, _ = mapping.cca(cite(spark, d), imaging(spark, d), SHARED)
    part = lambda side, t: t.select(F.lit(side).alias("side"), F.col("cell_id").cast("string").alias("cell_id"), "vec")
    return part("r", r).unionByName(part("q", q))


@query()
def map_codex_to_cite(spark, d):
    r = cite(spark, d)
    return mapping.correct_in_chunks(r, imaging(spark, d), r, SHARED, num_chunks=2, seed=30, num_cc=10)


# Clusters


@query(f"""WITH {_EMB}, l AS (SELECT e.id, e.v, x.label FROM emb e JOIN embeddings x ON x.vec_id = e.id), n AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
s AS (SELECT a.id, a.label AS own, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS s FROM l a, l b GROUP BY 1, 2, 3),
w AS (SELECT id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM s JOIN n ON n.label = s.other GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS mean_silhouette, count(*) AS n FROM w WHERE b IS NOT NULL""")
def silhouette_mean(spark, d):
    return clustering.silhouette(imaging(spark, d), imaging_labels(spark, d)).withColumn("mean_silhouette", r6("mean_silhouette"))


_RUNS = "runs AS (SELECT 1 AS run_id, vec_id AS cell_id, label FROM embeddings UNION ALL SELECT 2, vec_id, label // 2 FROM embeddings UNION ALL SELECT 3, vec_id, CASE WHEN label = 0 THEN -1 ELSE label END FROM embeddings)"


def _runs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), "label")
    return (
        e.select(F.lit(1).alias("run_id"), "cell_id", "label").unionByName(e.select(F.lit(2).alias("run_id"), "cell_id", F.floor(F.col("label") / 2).cast("int").alias("label")))
        .unionByName(e.select(F.lit(3).alias("run_id"), "cell_id", F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).alias("label")))
    )


@query(f"WITH {_RUNS} SELECT a.cell_id AS i, b.cell_id AS j, round(1 - count(*) / 3.0, 6) AS dissimilarity FROM runs a JOIN runs b ON a.run_id = b.run_id AND a.label = b.label AND a.label <> -1 AND a.cell_id < b.cell_id GROUP BY 1, 2")
def consensus_dissimilarity(spark, d):
    return clustering.consensus_dissimilarity(_runs(spark, d), 3).withColumn("dissimilarity", r6("dissimilarity"))


@query("SELECT p_partkey AS cell_id, CASE WHEN count(*) OVER (PARTITION BY p_size) < 40 THEN -1 ELSE p_size END AS cluster FROM part")
def small_cluster_to_noise(spark, d):
    return clustering.small_to_noise(table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").alias("cluster")), 40)


@query("""WITH c AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label * 3 END AS c FROM embeddings), n AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM c WHERE c <> -1))
SELECT vec_id AS cell_id, CAST(coalesce(k, -1) AS INTEGER) AS cluster FROM c LEFT JOIN n USING (c)""")
def relabel_clusters(spark, d):
    return clustering.relabel(table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label") * 3).alias("cluster")))


@query(f"WITH {_EMB}, {nn_sql('n', 'emb', 'emb', 5)} SELECT least(q, d) AS a, greatest(q, d) AS b, CAST(count(*) AS DOUBLE) AS w FROM n GROUP BY 1, 2")
def cluster_graph_edges(spark, d):
    return clustering.graph_edges(clustering.knn_codex(imaging(spark, d), 5))


@query()
def cluster_codex(spark, d):
    return clustering.louvain(clustering.graph_edges(clustering.knn_codex(imaging(spark, d), 5)))


@query()
def parameter_scan(spark, d):
    return clustering.parameter_scan(imaging(spark, d), [5, 10], [3, 5])[0]


@query()
def consensus_clusters(spark, d):
    runs, labels = clustering.parameter_scan(imaging(spark, d), [5, 10], [2, 3])
    return clustering.consensus_cluster(runs, labels, imaging(spark, d), -1.0, 0.3, 5) if runs.where("silhouette IS NOT NULL").limit(1).count() else imaging(spark, d).select("cell_id", F.lit(-1).alias("cluster"))


# Adjacency

_LABEDGE = "le AS (SELECT a.cluster AS f, b.cluster AS g FROM edges JOIN lab a ON a.cell_id = i JOIN lab b ON b.cell_id = j)"
_PAIRS = "pairs AS (SELECT a.c AS f, b.c AS g FROM (SELECT DISTINCT cluster AS c FROM lab) a, (SELECT DISTINCT cluster AS c FROM lab) b WHERE a.c <= b.c)"


@query(f"WITH {_POS}, {_GRAPH}, {_CODEX_LAB}, {_LABEDGE}, {_PAIRS}, s AS (SELECT f, g, count(*) AS n FROM le GROUP BY 1, 2) SELECT f, g, CAST(coalesce(n, 0) AS DOUBLE) AS score FROM pairs LEFT JOIN s USING (f, g)")
def adjacency_clusters(spark, d):
    return adjacency.cluster_score(adjacency.knn_graph(positions(spark, d), 3), codex_labels(spark, d))


def _soft_inputs(spark, d):
    """Edges between imaging cells by place (first three elements) and soft membership by transfer."""
    e = imaging(spark, d)
    at = e.select("cell_id", *[F.col("vec")[i].alias(c) for i, c in enumerate("xyz")])
    return stored(adjacency.knn_graph(at, 3), "edges")


_EG = """near AS (SELECT a.id AS q, b.id AS d, round(sqrt((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2 + (a.v[3] - b.v[3]) ** 2), 9) AS dist FROM emb a JOIN emb b ON a.id <> b.id),
spat AS (SELECT q, d FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d) <= 3), edges AS (SELECT q AS i, d AS j FROM spat UNION SELECT d, q FROM spat)"""


@query(f"""{_T}, {_CITE_LAB}, {_EG}, m AS (SELECT codex_id AS cell_id, cluster, sum(weight) AS w FROM t JOIN lab ON cite_id = cell_id GROUP BY 1, 2), {_PAIRS.replace('FROM lab', 'FROM m')},
s AS (SELECT a.cluster AS f, b.cluster AS g, sum(a.w * b.w) AS s FROM edges JOIN m a ON a.cell_id = i JOIN m b ON b.cell_id = j GROUP BY 1, 2) SELECT f, g, round(coalesce(s, 0), 6) AS score FROM pairs LEFT JOIN s USING (f, g)""")
def adjacency_soft_clusters(spark, d):
    m = stored(transfer.soft_membership(_transfer(spark, d), cite_labels(spark, d)).select("cell_id", F.col("cluster").alias("feature"), F.col("weight").alias("value")), "soft")
    return adjacency.adjacency_score(_soft_inputs(spark, d), m, adjacency.all_pairs(m)).withColumn("score", r6("score"))


@query(f"""WITH {_EMB}, {_EG}, m AS (SELECT id AS cell_id, CAST(i AS VARCHAR) AS cluster, v[i] AS w FROM (SELECT id, v, unnest(range(1, 21)) AS i FROM emb)), {_PAIRS.replace('FROM lab', 'FROM m')},
s AS (SELECT a.cluster AS f, b.cluster AS g, sum(a.w * b.w) AS s FROM edges JOIN m a ON a.cell_id = i JOIN m b ON b.cell_id = j GROUP BY 1, 2) SELECT f, g, round(coalesce(s, 0), 5) AS score FROM pairs LEFT JOIN s USING (f, g)""")
def adjacency_features(spark, d):
    m = frames.to_long(imaging(spark, d))
    return adjacency.adjacency_score(_soft_inputs(spark, d), m, adjacency.all_pairs(m.select("feature").distinct())).withColumn("score", F.round("score", 5))


_Q = "r AS (SELECT *, row_number() OVER (ORDER BY p, f, g) AS k, count(*) OVER () AS m FROM tail), bh AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"


@query(f"""WITH {_POS}, {_GRAPH}, {_CODEX_LAB}, {_LABEDGE}, {_PAIRS}, s AS (SELECT f, g, count(*) AS n FROM le GROUP BY 1, 2), size AS (SELECT cluster AS c, count(*) AS n FROM lab GROUP BY 1),
h AS (SELECT pairs.f, pairs.g, coalesce(s.n, 0) AS x, (SELECT sum(n) FROM size)::DOUBLE AS cells, a.n * (b.n - CAST(pairs.f = pairs.g AS INT))::DOUBLE AS marked, (SELECT count(*) FROM edges)::DOUBLE AS drawn
  FROM pairs LEFT JOIN s USING (f, g) JOIN size a ON a.c = pairs.f JOIN size b ON b.c = pairs.g),
w AS (SELECT *, cells * (cells - 1) AS pop FROM h), term AS (SELECT f, g, x, exp(lgamma(marked + 1) - lgamma(k + 1) - lgamma(marked - k + 1) + lgamma(pop - marked + 1) - lgamma(drawn - k + 1) - lgamma(pop - marked - drawn + k + 1)
  - lgamma(pop + 1) + lgamma(drawn + 1) + lgamma(pop - drawn + 1)) AS t FROM (SELECT *, unnest(generate_series(x, CAST(least(marked, drawn) AS BIGINT))) AS k FROM w)),
tail AS (SELECT w.f, w.g, CAST(w.x AS DOUBLE) AS score, least(1.0, coalesce(sum(t), 0.0)) AS p FROM w LEFT JOIN term ON term.f = w.f AND term.g = w.g GROUP BY w.f, w.g, w.x), {_Q}
SELECT f, g, score, round(log10(p + 1e-12), 2) AS log10_p, round(log10(q + 1e-12), 2) AS log10_q FROM bh""")
def adjacency_cluster_p_values(spark, d):
    """The logarithms to base 10 of p and q, as the p of most pairs is next to nothing."""
    s = adjacency.with_q_values(adjacency.cluster_p_values(stored(adjacency.knn_graph(positions(spark, d), 3), "edges"), codex_labels(spark, d)))
    return s.select("f", "g", "score", *[F.round(F.log10(F.col(x) + 1e-12), 2).alias(f"log10_{x}") for x in "pq"])


# half of erfc(x / sqrt 2): a continued fraction beyond 2, a power series within
_FAR = "exp(-{x} * {x} / 2) / sqrt(2 * pi()) / ({x} + list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(120, 0, -1), lambda k: k::DOUBLE)), lambda a, k: k / ({x} + a)))"
_NEAR = "0.5 - z / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp(k * ln(greatest(z * z, 1e-300) / 2) - lgamma(k + 1)) / (2 * k + 1)))"


@query(f"""WITH {_EMB}, {_EG}, m AS (SELECT id AS cell_id, CAST(i AS VARCHAR) AS cluster, v[i] AS w FROM (SELECT id, v, unnest(range(1, 21)) AS i FROM emb)), {_PAIRS.replace('FROM lab', 'FROM m')},
s AS (SELECT a.cluster AS f, b.cluster AS g, sum(a.w * b.w) AS s FROM edges JOIN m a ON a.cell_id = i JOIN m b ON b.cell_id = j GROUP BY 1, 2), y AS (SELECT i AS cell_id, cluster, sum(w) AS y FROM edges JOIN m ON cell_id = j GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT i)::DOUBLE AS n FROM edges), fs AS (SELECT cluster AS f, sum(w) AS f1, sum(w * w) AS f2 FROM m WHERE cell_id IN (SELECT i FROM edges) GROUP BY 1), gs AS (SELECT cluster AS g, sum(y) AS g1, sum(y * y) AS g2 FROM y GROUP BY 1),
z AS (SELECT f, g, coalesce(s, 0) AS score, f1 * g1 / n AS mean, sqrt((f2 - f1 * f1 / n) * (g2 - g1 * g1 / n) / (n - 1)) AS sd FROM pairs LEFT JOIN s USING (f, g) JOIN fs USING (f) JOIN gs USING (g), nn),
zz AS (SELECT *, (score - mean) / sd AS z FROM z),
tail AS (SELECT f, g, score, mean, sd, CASE WHEN z > 2 THEN {_FAR.format(x='z')} WHEN z < -2 THEN 1 - {_FAR.format(x='(-z)')} ELSE {_NEAR} END AS p FROM zz), {_Q}
SELECT f, g, round(score, 5) AS score, round(mean, 5) AS mean, round(sd, 5) AS sd, round(p, 6) AS p, round(q, 6) AS q FROM bh""")
def adjacency_feature_p_values(spark, d):
    """The null's moments over all deals, its normal tail and q."""
    m = stored(frames.to_long(imaging(spark, d)), "long")
    s = adjacency.null_moments(_soft_inputs(spark, d), m, adjacency.all_pairs(m.select("feature").distinct()))
    s = adjacency.with_q_values(adjacency.with_p_values(s))
    return s.select("f", "g", *[F.round(x, n).alias(x) for x, n in (("score", 5), ("mean", 5), ("sd", 5), ("p", 6), ("q", 6))])


@query("SELECT DISTINCT a.n_name AS f, b.n_name AS g FROM nation a JOIN nation b ON a.n_name <= b.n_name")
def pair_enumeration(spark, d):
    return adjacency.all_pairs(table(spark, d, "nation").select(F.col("n_name").alias("feature")))


_BH = "t AS (SELECT p_brand AS f, p_type AS g, round(avg(p_retailprice) / 3000, 9) AS p FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, f, g) AS k, count(*) OVER () AS m FROM t)"


@query(f"WITH {_BH} SELECT f, g, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r")
def bh_qvalues(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("f"), F.col("p_type").alias("g")).agg(F.round(F.avg("p_retailprice") / 3000, 9).alias("p"))
    return adjacency.with_q_values(t).withColumn("q", F.round("q", 9))


@query("""WITH s AS (SELECT n_regionkey AS a, n_nationkey % 5 AS b, least(n_regionkey, n_nationkey % 5) AS f, greatest(n_regionkey, n_nationkey % 5) AS g, (n_nationkey + 1) / 100.0 AS q FROM nation),
u AS (SELECT f, g, min(q) AS q FROM s GROUP BY 1, 2), w AS (SELECT f, g, -log10(q + 1e-10) AS v FROM u UNION ALL SELECT g, f, -log10(q + 1e-10) FROM u)
SELECT CAST(f AS VARCHAR) AS f, round(max(v) FILTER (g = 0), 6) AS c0, round(max(v) FILTER (g = 1), 6) AS c1, round(max(v) FILTER (g = 2), 6) AS c2, round(max(v) FILTER (g = 3), 6) AS c3, round(max(v) FILTER (g = 4), 6) AS c4 FROM w GROUP BY 1""")
def adjacency_heatmap(spark, d):
    a, b = F.col("n_regionkey"), F.col("n_nationkey") % 5
    s = table(spark, d, "nation").groupBy(F.least(a, b).cast("string").alias("f"), F.greatest(a, b).cast("string").alias("g")).agg(F.min((F.col("n_nationkey") + 1) / 100.0).alias("q"))
    h = adjacency.heatmap(s, [str(i) for i in range(5)])
    return h.select("f", *[F.round(F.col(str(i)), 6).alias(f"c{i}") for i in range(5)])


# Views


def _plane(spark, d):
    return imaging(spark, d).select("cell_id", F.col("vec")[0].alias("e1"), F.col("vec")[1].alias("e2"))


@query(f"""WITH {_POS}, c AS (SELECT cell_id, min(codex_size) AS v FROM codex_gate WHERE codex_size IS NOT NULL AND NOT isnan(codex_size) AND cell_id IS NOT NULL GROUP BY 1), m AS (SELECT min(x) AS mx, min(y) AS my FROM pos),
j AS (SELECT p.cell_id, round(x - mx, 3) AS e1, round(-(y - my), 3) AS e2, coalesce(v, 0.0) AS value1 FROM m, pos p LEFT JOIN c ON c.cell_id = p.cell_id)
SELECT *, CAST(CASE WHEN max(value1) OVER () > min(value1) OVER () THEN least(100, greatest(1, ceil(round((value1 - min(value1) OVER ()) / (max(value1) OVER () - min(value1) OVER ()) * 100, 9)))) ELSE 50 END AS INTEGER) AS bin1, max(value1) OVER () > 0 AS signal FROM j""")
def plot_expr_spatial(spark, d):
    size = table(spark, d, "codex_gate").where("codex_size IS NOT NULL AND NOT isnan(codex_size) AND cell_id IS NOT NULL").groupBy("cell_id").agg(F.min("codex_size").alias("value")).select("cell_id", F.lit("size").alias("feature"), "value")
    return views.expression_spatial(positions(spark, d), size, ["size"]).withColumns({"e1": F.round("e1", 3), "e2": F.round("e2", 3)})


@query(f"WITH {_POS}, {_CODEX_LAB} SELECT p.cell_id, round(x - mx, 3) AS e1, round(y - my, 3) AS e2, coalesce(cluster, '-1') AS cluster FROM (SELECT min(x) AS mx, min(y) AS my FROM pos), pos p LEFT JOIN lab ON lab.cell_id = p.cell_id")
def plot_cluster_spatial(spark, d):
    return views.clusters_spatial(positions(spark, d), codex_labels(spark, d)).withColumns({"e1": F.round("e1", 3), "e2": F.round("e2", 3)})


@query("SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(label AS VARCHAR) AS cluster FROM embeddings")
def plot_cluster_embedding(spark, d):
    return views.clusters(_plane(spark, d), imaging_labels(spark, d))


@query("SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, vec_id = 7 AS marked, CAST(vec_id = 7 AS INTEGER) AS layer FROM embeddings")
def plot_index_flag(spark, d):
    return views.marked(_plane(spark, d), 7)


@query(f"{_T}, {_RNA}, g AS (SELECT codex_id, ln(1 + 1000 * sum(weight * value)) AS v FROM t JOIN rna ON cite_id = cell_id WHERE feature = 2 GROUP BY 1) SELECT id AS cell_id, v[1] AS e1, v[2] AS e2, round(coalesce(g.v, 0.0), 6) AS value, coalesce(g.v, 0) <> 0 AS drawn_last, (SELECT max(v) > 0 FROM g) AS signal FROM (SELECT id, v FROM emb) e LEFT JOIN g ON g.codex_id = e.id".replace("v[1] AS e1, v[2] AS e2", "e.v[1] AS e1, e.v[2] AS e2"))
def app_gene_view(spark, d):
    return views.app_view(_plane(spark, d), "gene", long=cite_expression(spark, d), feature=2, transfer=_transfer(spark, d)).select("cell_id", "e1", "e2", r6("value").alias("value"), "drawn_last", "signal")


@query()
def umap_layout(spark, d):
    return embedding.layout(imaging(spark, d), 15, rounds=10)[0]
