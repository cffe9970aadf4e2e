"""Queries of the operators for training data, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.llm import mixing
from cellweft.llm.leak_scan import leaked_items
from cellweft.llm.percentiles import bisect_percentiles, combine, summarise
from cellweft.llm.sentences import split_sentences
from cellweft.llm.similar_vectors import Hashing, similar_vectors, tuned
from cellweft.llm.similarity_clusters import similarity_clusters
from cellweft.session import parse_cluster, small, stored, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item how many documents hold it and how much of it at most."""
    items = table(spark, sf_dir, "eval_items")
    leaks = leaked_items(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.col("held") / F.col("item_size")).alias("most_held"))
    return items.select("item_id", "item_lang", "task_name").join(leaks, "item_id", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "most_held": F.coalesce("most_held", F.lit(0.0))})



# Similar vectors

#: Dataset, table, vector column, elements of a whole vector.
VECTORS = (("codex", "codex_clean", "codex_clean", 30), ("cite", "cite_latent", "cite_latent", 20))
#: Fixed value: 1 - Pearson correlation up to which two cells count as a found pair.
PAIR_DISTANCE = 0.001
#: Slots of about eighteen times the distance sought: two vectors at the limit share or touch a bucket of one table in 9,997 of 10,000 cases.
PAIR_HASHING = Hashing(tables=5, hashes=14, width=0.8, probes=1)
#: Share of the true nearest neighbours that the tables of p2_neighbours are chosen for.
RECALL = 0.95


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for dataset, name, column, dim in VECTORS:
        near = similar_vectors(table(spark, sf_dir, name), "cell_id", column, dim, k=5, max_distance=PAIR_DISTANCE, hashing=PAIR_HASHING)
        part = near.select(F.lit(dataset).alias("dataset"), F.least("query_id", "neighbour_id").alias("left_id"), F.greatest("query_id", "neighbour_id").alias("right_id")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest cells of every row whose row_id is divisible by 20, searched among all rows."""
    out = None
    for dataset, name, column, dim in VECTORS:
        rows, asks = table(spark, sf_dir, name), F.col("row_id") % 20 == 0
        near = similar_vectors(rows, "cell_id", column, dim, k=5, queries=asks, hashing=tuned(rows, "cell_id", column, dim, k=5, queries=asks, recall=RECALL)).select(F.lit(dataset).alias("dataset"), "query_id", "neighbour_id", "nn_rank", F.round("nn_dist", 9).alias("nn_dist"))
        out = near if out is None else out.unionByName(near)
    return out


# Percentiles of the gate table

_FIELDS = ("codex_size", "blank_1", "blank_2", "blank_3", "blank_4")


def gate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, run_day, field_name, value): codex_size and the four blanks of every row with a slide, one row each; nulls and NaNs left out."""
    value = [F.col("codex_size"), *[F.get("codex_blanks", F.lit(i)) for i in range(4)]]
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), v.alias("value")) for f, v in zip(_FIELDS, value)])
    return table(spark, sf_dir, "codex_gate").where("slide_id IS NOT NULL").select("slide_id", "run_day", F.inline(pairs)).where("value IS NOT NULL AND NOT isnan(value)")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bisect_percentiles(gate_values(spark, sf_dir), ["slide_id", "field_name"], "value", [0.1, 0.9])
    over = got.join(table(spark, sf_dir, "gate_limits"), "field_name")
    side = F.when((F.col("p") == 0.9) & (F.col("value") > F.col("upper_limit")), "high").when((F.col("p") == 0.1) & (F.col("value") < F.col("lower_limit")), "low")
    return over.select("slide_id", "field_name", side.alias("side")).where("side IS NOT NULL").distinct()


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and deciles per slide and field over all days."""
    return bisect_percentiles(gate_values(spark, sf_dir), ["slide_id", "field_name"], "value", [0.1, 0.25, 0.5, 0.75, 0.9]).select("slide_id", "field_name", "p", "value", "n")


def p4_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians per slide and field combined from the summaries of single run days; ranks are within 2 % of the rows."""
    days = summarise(gate_values(spark, sf_dir), ["slide_id", "field_name"], "run_day", "value", points=50)
    return combine(days, ["slide_id", "field_name"], [0.5])


# Similarity clusters

_LABELS = {"codex": "codex_clusters", "cite": "cite_clusters"}


def _labelled(spark: SparkSession, sf_dir: str, dataset: str, name: str, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(cell, cluster, likeness, cluster_no) of the cells in a cluster, and (cluster, major) with the commonest number, -1 and none left out (ties: the smaller)."""
    placed = similarity_clusters(table(spark, sf_dir, name), "cell_id", column, dim).where("cluster IS NOT NULL")
    labels = table(spark, sf_dir, _LABELS[dataset]).select("cell_id", parse_cluster("cluster_label").alias("cluster_no")).where("cluster_no IS NOT NULL").distinct()
    both = stored(placed.join(labels, placed.id == labels.cell_id, "left").select("id", "cluster", "likeness", "cluster_no"), "labelled")
    votes = both.where("cluster_no <> -1").groupBy("cluster", "cluster_no").agg(F.count(F.lit(1)).alias("votes"))
    major = votes.groupBy("cluster").agg(F.max_by("cluster_no", F.struct("votes", -F.col("cluster_no"))).alias("major"), F.max("votes").alias("major_cells"))
    return both, major


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for dataset, name, column, dim in VECTORS:
        both, major = _labelled(spark, sf_dir, dataset, name, column, dim)
        part = both.where("cluster_no <> -1").join(small(major), "cluster").where("cluster_no <> major").select(F.lit(dataset).alias("dataset"), F.col("id").alias("cell_id")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster its cells, its three most typical ones, and the label that most of them carry with its share of the labelled."""
    out = None
    for dataset, name, column, dim in VECTORS:
        both, major = _labelled(spark, sf_dir, dataset, name, column, dim)
        cells = both.groupBy("cluster", "id").agg(F.max("likeness").alias("likeness"), F.max(F.coalesce(F.col("cluster_no") != -1, F.lit(False)).cast("int")).alias("labelled"))
        size = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"), F.sum("labelled").alias("labelled_cells"), F.avg("likeness").alias("mean_likeness"))
        top = cells.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("likeness").desc(), "id"))).where("rn <= 3")
        typical = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("t")).select("cluster", F.col("t.id").alias("typical_cells"))
        part = size.join(typical, "cluster").join(major, "cluster", "left").select(F.lit(dataset).alias("dataset"), "cluster", "cells", "typical_cells", "mean_likeness", F.col("major").alias("common_label"), F.try_divide("major_cells", "labelled_cells").alias("common_label_share"))
        out = part if out is None else out.unionByName(part)
    return out


# Mixtures of sources


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("source", F.lower(F.trim("source"))).where("source IS NOT NULL")
    return stored(mixing.count_tokens(docs, keep=("doc_id", "source")), "tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that the mixture leaves short of their target with every document at the cap."""
    return p7_shares(spark, sf_dir).where("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the target and the share that the mixture reached."""
    counts = _counted(spark, sf_dir)
    plans = mixing.plan(counts, table(spark, sf_dir, "mix_targets"))
    return mixing.report(mixing.mixture(counts, plans), plans)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    counts = _counted(spark, sf_dir)
    return mixing.mixture(counts, mixing.plan(counts, table(spark, sf_dir, "mix_targets")))


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target and texts what must hold of its mixture: no document beyond max_repeats, each at one of the two whole numbers around its expected copies, all together within one of their sum."""
    counts = _counted(spark, sf_dir)
    plans = mixing.plan(counts, table(spark, sf_dir, "mix_targets"))
    both = mixing.mixture(counts, plans).join(small(plans.select("source", "expected_copies", "max_repeats")), "source")
    each = F.col("copies").between(F.floor("expected_copies"), F.ceil("expected_copies"))
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.bool_and(F.col("copies") <= F.col("max_repeats")).alias("under_cap"), F.bool_and(each).alias("rounded"),
        (F.abs(F.sum("copies") - F.sum("expected_copies")) < 1.000001).alias("sum_kept"),
    )


# Sentences


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents").where("text_form = 'plain'")).distinct()


def p8_all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, of either form, the number of its sentences and the length of the longest."""
    spans = split_sentences(table(spark, sf_dir, "documents"))
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


QUERIES = {
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p4_found": p4_found,
    "p4_percentiles": p4_percentiles,
    "p4_combined_days": p4_combined_days,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_found": p6_found,
    "p6_item_report": p6_item_report,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mixture": p7_mixture,
    "p7_bounds": p7_bounds,
    "p8_found": p8_found,
    "p8_all_texts": p8_all_texts,
}

_VALUES = """vals AS (SELECT slide_id, run_day, field_name, value FROM (
  SELECT slide_id, run_day, unnest(['codex_size', 'blank_1', 'blank_2', 'blank_3', 'blank_4']) AS field_name,
         unnest([codex_size, codex_blanks[1], codex_blanks[2], codex_blanks[3], codex_blanks[4]]) AS value
  FROM codex_gate WHERE slide_id IS NOT NULL) WHERE value IS NOT NULL AND NOT isnan(value))"""
_UNIT = """{d}_u AS MATERIALIZED (SELECT DISTINCT id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM (
  SELECT cell_id AS id, list_transform({c}, lambda x: x - list_avg({c})) AS c FROM {t} WHERE cell_id IS NOT NULL AND len({c}) = {n}
  AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max({c}) > list_min({c})))"""
_UNITS = ", ".join(_UNIT.format(d=d, t=t, c=c, n=n) for d, t, c, n in VECTORS)
#: Plain shingles: the places of an item that any of its runs of five words (ten characters) covers, in the text with and without what stands in marks.
_HELD = r"""WITH sides AS (SELECT 0 AS kind, doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, item_id, item_text FROM eval_items WHERE item_text IS NOT NULL),
bare AS (SELECT DISTINCT kind, id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\p{Cf}', '', 'g'), '\[\[[^\[\]|]*\|', '', 'g'), '<ref[^<>]*?/>', ' ', 'g'), '</?(b|i|em|small|span|u|sup|sub)\b[^<>]*>', '', 'g')) AS t FROM sides),
readings AS (SELECT kind, id, t FROM bare UNION SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(t, '<!--.*?-->', ' ', 'gs'), '\{\{[^{}]*\}\}', ' ', 'g'), '<ref[^<>]*>[^<]*</ref>', ' ', 'g') FROM bare),
spaced AS (SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(t, '''''+|</?[a-z][^<>]*>', '', 'g'), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3041}-\x{30FF}\x{3400}-\x{9FFF}])', ' \1 ', 'g'), '[^\p{L}\p{N}\p{M}]+', ' ', 'g') AS t FROM readings),
words AS (SELECT kind, id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM spaced),
wide AS (SELECT id, len(list_filter(w, lambda x: len(x) = 1 AND ord(x) >= 3584)) * 2 > len(w) AS wide, w, len(w) AS n FROM words WHERE kind = 1),
grams AS (SELECT DISTINCT id AS item_id, n, wide, i, CASE WHEN wide THEN w[i : i + 9] ELSE w[i : i + 4] END AS g FROM wide, LATERAL (SELECT unnest(generate_series(1, n - CASE WHEN wide THEN 9 ELSE 4 END)) AS i)),
texts AS (SELECT id AS doc_id, w FROM words WHERE kind = 0),
held AS (SELECT DISTINCT doc_id, w[i : i + 4] AS g FROM texts, LATERAL (SELECT unnest(generate_series(1, len(w) - 4)) AS i) UNION SELECT DISTINCT doc_id, w[i : i + 9] FROM texts, LATERAL (SELECT unnest(generate_series(1, len(w) - 9)) AS i) WHERE len(list_filter(w, lambda x: len(x) = 1 AND ord(x) >= 3584)) > 9),
hits AS (SELECT DISTINCT doc_id, item_id, n, unnest(generate_series(i, i + CASE WHEN wide THEN 9 ELSE 4 END)) AS place FROM grams JOIN held USING (g)),
leak AS (SELECT doc_id, item_id, count(DISTINCT place) AS held, n FROM hits GROUP BY doc_id, item_id, n HAVING count(DISTINCT place) * 2 >= n)"""
SQL: dict[str, str] = {
    "p6_found": f"{_HELD} SELECT doc_id, item_id FROM leak",
    "p6_item_report": f"""{_HELD} SELECT item_id, item_lang, task_name, coalesce(documents, 0) AS documents, coalesce(most_held, 0.0) AS most_held FROM eval_items
LEFT JOIN (SELECT item_id, count(*) AS documents, max(held / n) AS most_held FROM leak GROUP BY 1) USING (item_id)""",
    "p2_found": f"WITH {_UNITS} "
    + " UNION ".join(f"SELECT '{d}' AS dataset, a.id AS left_id, b.id AS right_id FROM {d}_u a JOIN {d}_u b ON a.id < b.id WHERE 1 - list_dot_product(a.u, b.u) <= 0.001" for d, *_ in VECTORS),
    # bytes in the place of tokens: the answer holds for any measure of size
    "p7_found": """WITH d AS (SELECT lower(trim(source)) AS source, strlen(text) AS size FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY 1)
SELECT lower(trim(t.source)) AS source FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source)) WHERE target_share * (SELECT sum(size) FROM d) > max_repeats * coalesce(s.size, 0)""",
    "p7_bounds": """SELECT lower(trim(source)) AS source, count(*) AS documents, TRUE AS under_cap, TRUE AS rounded, TRUE AS sum_kept FROM documents
WHERE text IS NOT NULL AND lower(trim(source)) IN (SELECT lower(trim(source)) FROM mix_targets) GROUP BY 1""",
    "p4_found": f"""WITH {_VALUES}, q AS (SELECT slide_id, field_name, quantile_disc(value, 0.9) AS hi, quantile_disc(value, 0.1) AS lo FROM vals GROUP BY 1, 2)
SELECT slide_id, field_name, 'high' AS side FROM q JOIN gate_limits USING (field_name) WHERE hi > upper_limit
UNION ALL SELECT slide_id, field_name, 'low' FROM q JOIN gate_limits USING (field_name) WHERE lo < lower_limit""",
    "p4_percentiles": f"""WITH {_VALUES}, r AS (SELECT slide_id, field_name, value, row_number() OVER (PARTITION BY slide_id, field_name ORDER BY value) AS k,
  count(*) OVER (PARTITION BY slide_id, field_name) AS n FROM vals)
SELECT slide_id, field_name, p, value, n FROM r, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS p) WHERE k = greatest(1, ceil(round(p * n, 9)))""",
    "p4_combined_days": f"""WITH {_VALUES}, r AS (SELECT slide_id, field_name, run_day, value, row_number() OVER d AS k, count(*) OVER (PARTITION BY slide_id, field_name, run_day) AS n
  FROM vals WINDOW d AS (PARTITION BY slide_id, field_name, run_day ORDER BY value)),
s AS (SELECT slide_id, field_name, run_day, value, k - lag(k, 1, 0) OVER (PARTITION BY slide_id, field_name, run_day ORDER BY k) AS weight
  FROM r WHERE list_contains(list_transform(range(1, 51), lambda j: greatest(1, ceil(round(j / 50 * n, 9)))), k)),
c AS (SELECT slide_id, field_name, value, sum(sum(weight)) OVER (PARTITION BY slide_id, field_name ORDER BY value) AS upto, sum(sum(weight)) OVER (PARTITION BY slide_id, field_name) AS n FROM s GROUP BY 1, 2, 3)
SELECT slide_id, field_name, 0.5::DOUBLE AS p, min(value) AS value, CAST(any_value(n) AS BIGINT) AS n FROM c WHERE upto >= greatest(1, ceil(round(0.5 * n, 9))) GROUP BY 1, 2""",
}
