"""Every query of the core that has SQL gives the SQL's rows; the others run and keep their schema."""

import pytest
from conftest import same_rows

from cellweft.operators.knn import knn
from cellweft.plans import engine_queries, hotkey_queries, spatial_queries

MODULES = (spatial_queries, hotkey_queries, engine_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data_dir, duck, name):
    same_rows(QUERIES[name](spark, data_dir), duck, SQL[name])


@pytest.mark.parametrize("name", ["clean_cite_gaussian", "clean_codex_nb", "parameter_scan", "adjacency_cluster_p_values"])
def test_query_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark, data_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["adjacency_clusters"](spark, data_dir).columns == ["f", "g", "score"]


@pytest.mark.parametrize("limit", [20_000, 10])  # the side with fewer numbers is held, or none
@pytest.mark.parametrize("name", ["fastknn_vote", "anchors_mnn", "anchor_weights", "integration_vectors"])
def test_large_sides_match_sql(spark, data_dir, duck, monkeypatch, name, limit):
    monkeypatch.setattr("cellweft.operators.knn.BROADCAST_NUMBERS", limit)
    monkeypatch.setitem(knn.__kwdefaults__, "block", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions stay apart, as those of large tables do
    try:
        same_rows(QUERIES[name](spark, data_dir), duck, SQL[name])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_integration_vectors_with_many_reference_cells(spark, data_dir, tmp_path, monkeypatch):
    """The shape of a large run: reference cells stream past the imaging cells, and past those near them for their own neighbours."""
    import duckdb

    c = duckdb.connect()
    many = f"SELECT cell_id || '_' || n AS cell_id, cite_latent FROM '{data_dir}/cite_latent.parquet', range(20) AS t(n)"  # equal vectors: ties
    for name, sql in (("cite_latent", many), ("embeddings", f"SELECT * FROM '{data_dir}/embeddings.parquet' ORDER BY vec_id LIMIT 25")):
        c.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr("cellweft.operators.knn.BROADCAST_NUMBERS", 40_000)
    monkeypatch.setitem(knn.__kwdefaults__, "block", 64)
    streamed, as_is = [], knn.__globals__["_streamed"]
    monkeypatch.setattr("cellweft.operators.knn._streamed", lambda data, *a: streamed.append(a[-1]) or as_is(data, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_rows(QUERIES["integration_vectors"](spark, str(tmp_path)), c, SQL["integration_vectors"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(streamed) == 2 and streamed[0] == streamed[1]  # all reference cells, for the imaging cells and for those near them
