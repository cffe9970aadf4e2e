"""Queries per cluster number, where few numbers hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators.hotkeys import compress, heavy_keys, profile, salted_join, weighted_percentiles
from cellweft.session import parse_cluster, stored, table, usable_vector

#: Fixed value: the share of the rows with a number from which a cluster counts as found.
FOUND_SHARE = 0.04
_TABLES = (("codex", "codex_clusters"), ("cite", "cite_clusters"))


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(cluster_no, value, weight): how often each spelling of a cluster number occurs."""
    return compress(table(spark, sf_dir, name).select(parse_cluster("cluster_label").alias("cluster_no"), "cluster_label"), ["cluster_no"], "cluster_label")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [heavy_keys(_labels(spark, sf_dir, t), "cluster_no", FOUND_SHARE).select(F.lit(d).alias("dataset"), "cluster_no") for d, t in _TABLES]
    return parts[0].unionByName(parts[1])


def p3_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset and cluster: rows, distinct cells, the commonest spelling, and the median arrival in seconds since the epoch."""
    out = None
    for d, t in _TABLES:
        rows = table(spark, sf_dir, t).withColumn("cluster_no", parse_cluster("cluster_label")).where("cluster_no IS NOT NULL")
        cells = profile(compress(rows, ["cluster_no"], "cell_id"), ["cluster_no"]).select("cluster_no", "rows", F.col("distinct_values").alias("cells"))
        spell = profile(compress(rows, ["cluster_no"], "cluster_label"), ["cluster_no"]).select("cluster_no", F.col("mode").alias("common_label"), F.col("mode_rows").alias("common_label_rows"), F.col("distinct_values").alias("spellings"))
        second = weighted_percentiles(compress(rows, ["cluster_no"], F.floor(F.unix_micros(F.col("loaded_at").cast("timestamp")) / 1_000_000).cast("double")), ["cluster_no"], [0.5]).select("cluster_no", F.col("value").cast("bigint").alias("median_arrival_s"))
        part = cells.join(spell, "cluster_no").join(second, "cluster_no", "left").select(F.lit(d).alias("dataset"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p3_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled cell with the rows and the distinct cells of its cluster; the large clusters' cells are spread over tasks."""
    out = None
    for d, t in _TABLES:
        rows = table(spark, sf_dir, t).select(parse_cluster("cluster_label").alias("cluster_no"), "cell_id").where("cluster_no IS NOT NULL AND cell_id IS NOT NULL")
        weighted = stored(compress(rows, ["cluster_no"], "cell_id"), "members")
        size = profile(weighted, ["cluster_no"]).select("cluster_no", F.col("rows").alias("cluster_rows"), F.col("distinct_values").alias("cluster_cells"))
        part = salted_join(weighted.select("cluster_no", F.col("value").alias("cell_id"), F.col("weight").alias("cell_rows")), size, "cluster_no")
        part = part.select(F.lit(d).alias("dataset"), "cluster_no", "cell_id", "cell_rows", "cluster_rows", "cluster_cells")
        out = part if out is None else out.unionByName(part)
    return out


_VECTORS = (("codex", "codex_clusters", "codex_clean", "codex_clean", 30), ("cite", "cite_clusters", "cite_latent", "cite_latent", 20))


def p3_vector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster and element of the vectors the mean over all whole vectors of its cells, one row for each vector and
    number of the cell. Values are summed in whole millionths, so that no order of adding changes the result."""
    out = None
    for d, labels, vectors, column, dim in _VECTORS:
        cells = table(spark, sf_dir, labels).select(parse_cluster("cluster_label").alias("cluster_no"), "cell_id").where("cluster_no IS NOT NULL").distinct()
        v = table(spark, sf_dir, vectors).where(usable_vector(column, dim)).select("cell_id", *[F.floor(F.get(column, F.lit(i)) * 1e6).cast("bigint").alias(f"e{i}") for i in range(dim)])
        sums = v.join(cells, "cell_id").groupBy("cluster_no").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(dim)])
        each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("element"), (F.col(f"e{i}").cast("double") / (F.col("rows") * F.lit(1e6))).alias("mean")) for i in range(dim)])
        part = sums.select(F.lit(d).alias("dataset"), "cluster_no", F.col("rows").alias("vectors"), F.inline(each))
        out = part if out is None else out.unionByName(part)
    return out


_NUM = r"TRY_CAST(nullif(regexp_extract(cluster_label, '(?i)^\s*(?:cluster[_\s]?|c[_\s]?)?(-?\d+)(?:\.0*)?\s*$', 1), '') AS BIGINT)"
SQL = {
    "p3_found": " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, cluster_no FROM (SELECT {_NUM} AS cluster_no, count(*) AS n FROM {t} GROUP BY 1) WHERE cluster_no IS NOT NULL
        AND n >= 0.04 * (SELECT count(*) FROM {t} WHERE {_NUM} IS NOT NULL)"""
        for d, t in _TABLES
    ),
    "p3_cluster_members": " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, cluster_no, cell_id, n AS cell_rows, CAST(sum(n) OVER (PARTITION BY cluster_no) AS BIGINT) AS cluster_rows, count(*) OVER (PARTITION BY cluster_no) AS cluster_cells
        FROM (SELECT {_NUM} AS cluster_no, cell_id, count(*) AS n FROM {t} WHERE cell_id IS NOT NULL GROUP BY 1, 2) WHERE cluster_no IS NOT NULL"""
        for d, t in _TABLES
    ),
    "p3_vector_profile": " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, cluster_no, count(*) AS vectors, element, CAST(sum(CAST(floor(x * 1e6) AS BIGINT)) AS DOUBLE) / (count(*) * 1e6) AS mean FROM (
        SELECT cluster_no, unnest(range({n})) AS element, unnest({c}) AS x FROM (SELECT DISTINCT {_NUM} AS cluster_no, cell_id FROM {t}) l JOIN {v} USING (cell_id)
        WHERE cluster_no IS NOT NULL AND len({c}) = {n} AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max({c}) > list_min({c})) GROUP BY cluster_no, element"""
        for d, t, v, c, n in _VECTORS
    ),
    "p3_cluster_profile": " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, a.*, common_label, common_label_rows, spellings, median_arrival_s FROM
        (SELECT {_NUM} AS cluster_no, count(*) AS "rows", count(DISTINCT cell_id) AS cells, CAST(quantile_disc(CAST(floor(epoch_us(loaded_at) / 1000000) AS BIGINT), 0.5) AS BIGINT) AS median_arrival_s FROM {t} GROUP BY 1) a
        JOIN (SELECT cluster_no, arg_max(cluster_label, (n, -ord)) AS common_label, max(n) AS common_label_rows, count(*) AS spellings
              FROM (SELECT {_NUM} AS cluster_no, cluster_label, count(*) AS n, row_number() OVER (ORDER BY cluster_label) AS ord FROM {t} GROUP BY 1, 2) GROUP BY 1) b ON a.cluster_no = b.cluster_no"""
        for d, t in _TABLES
    ).replace("SELECT 'codex' AS dataset, a.*", "SELECT 'codex' AS dataset, a.cluster_no, a.\"rows\", a.cells, a.median_arrival_s AS median_arrival_s").replace("SELECT 'cite' AS dataset, a.*", "SELECT 'cite' AS dataset, a.cluster_no, a.\"rows\", a.cells, a.median_arrival_s AS median_arrival_s").replace("spellings, median_arrival_s FROM", "spellings FROM"),
}
QUERIES = {"p3_found": p3_found, "p3_cluster_profile": p3_cluster_profile, "p3_cluster_members": p3_cluster_members, "p3_vector_profile": p3_vector_profile}
