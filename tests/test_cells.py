"""Gates, normalisation, neighbours, anchors, mixtures, clusters, adjacency, sources on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweft import api, frames
from cellweft.functions import scalar
from cellweft.operators import adjacency, anchors, clustering, embedding, mapping, mixtures, qc, transfer, views
from cellweft.operators.knn import closest_points, correlation_distance, find_nn_rna, knn, spatial_knn
from cellweft.sources import fcs, tabular
from cellweft.streaming import live


def vecs(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"cell_id {kind}, vec array<double>")


def test_gate_keeps_constant_cells_and_uses_any_and_all(spark):
    schema = "cell_id string, size double, blanks array<double>, lower string"
    same = spark.createDataFrame([(str(i), 0.0, [0.0, 0.0], "x") for i in range(10)], schema)
    assert qc.gate(same, 2).count() == 10
    rows = [("a", 5.0, [1.0, -9.0], "x"), ("b", 5.0, [-9.0, -9.0], "x"), ("c", 5.0, [1.0, 99.0], "x"), ("d", 50.0, [1.0, 1.0], "x"), ("e", None, [1.0, 1.0], "x"), ("f", 5.0, [1.0], "x"), ("g", 5.0, [1.0, None], "x"), ("h", float("nan"), [1.0, 1.0], "x")]
    got = qc.gate(spark.createDataFrame(rows, schema), 2, (0, 10), (10, 10), (0, 0))
    assert [r[0] for r in got.select("cell_id").collect()] == ["a"]
    assert got.columns == ["cell_id", "size", "blanks", "lower"]


def test_normalisation(spark):
    long = spark.createDataFrame([("z", "a", 0.0), ("z", "b", 0.0), ("y", "a", 1.0), ("y", "b", 3.0)], "cell_id string, feature string, value double")
    got = {(r[0], r[1]): r[2] for r in mixtures.normalise_cells(long).collect()}
    assert got == {("z", "a"): 0.0, ("z", "b"): 0.0, ("y", "a"): 0.25, ("y", "b"): 0.75}
    const = long.withColumn("value", F.when(F.col("feature") == "a", F.lit(7.0)).otherwise(F.col("value")))
    mm = {(r[0], r[1]): r[2] for r in mixtures.min_max_features(const).collect()}
    assert mm["z", "a"] == 0.0 and mm["y", "b"] == 1.0
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    s = one.select(scalar.standardise(F.col("v")), scalar.l2_normalise(F.col("v")), scalar.normal_cdf(F.lit(1.0))).first()
    assert s[0] == [-1.0, 0.0, 1.0] and abs(sum(x * x for x in s[1]) - 1) < 1e-12 and abs(s[2] - 0.841344746) < 2e-7


def test_frames(spark):
    d = vecs(spark, [("a", [1.0, 0.0]), ("b", [0.0, 2.0])])
    long = frames.to_long(d, ["f", "g"], zeros=False)
    assert {tuple(r) for r in long.collect()} == {("a", "f", 1.0), ("b", "g", 2.0)}
    assert {r[0]: r[1] for r in frames.to_dense(long, ["f", "g"]).collect()} == {"a": [1.0, 0.0], "b": [0.0, 2.0]}
    w = spark.createDataFrame([("f", 1, 2), ("g", 3, 4)], "name string, c1 int, c2 int")
    assert frames.transpose(w, "name", ["c1", "c2"]).count() == 4
    ids = frames.with_ids(spark.createDataFrame([(v,) for v in (30, 10, 20)], "v int"), ["v"])
    assert sorted((int(r["cell_id"]), r["v"]) for r in ids.collect()) == [(1, 10), (2, 20), (3, 30)]


def test_filters(spark):
    df = spark.createDataFrame([("g", 2, "second"), ("g", 1, "first"), ("h", 3, "x")], "name string, pos int, v string")
    assert {r["v"] for r in qc.first_wins(df, "name", "pos").collect()} == {"first", "x"}
    with pytest.raises(ValueError):
        qc.common_features(["a", "b"], ["a", "c"])
    assert qc.common_features(["c", "a", "b"], ["a", "b", "c"]) == ["c", "a", "b"]


@pytest.mark.parametrize("metric", ["correlation", "euclidean"])
def test_knn_both_ways(spark, metric, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(60, 5)), 1)
    x[7] = x[3]
    x[11] = 1.0
    rows = [(f"c{i:02}", [float(v) for v in x[i]]) for i in range(60)]
    df = vecs(spark, rows)
    whole = {(r["q"], r["rank"]): (r["d"], r["dist"]) for r in knn(df, df, 4, metric=metric).collect()}
    import cellweft.operators.knn as module

    monkeypatch.setattr(module, "BROADCAST_NUMBERS", 10)
    blocks = {(r["q"], r["rank"]): (r["d"], r["dist"]) for r in knn(df, df, 4, metric=metric, block=16).collect()}
    assert whole == blocks
    assert whole["c03", 1][0] == "c03" and whole["c03", 2][0] == "c07"
    assert knn(df, df, 4, metric=metric, drop_self=True).where("q = d").count() == 0
    assert knn(df.limit(0), df, 4, metric=metric).count() == 0
    assert knn(df, df.limit(3), 100, metric=metric).count() == 180
    d = df.where("cell_id IN ('c00')").select(F.col("vec").alias("a")).crossJoin(df.where("cell_id = 'c01'").select(F.col("vec").alias("b"))).select(correlation_distance(F.col("a"), F.col("b"))).first()[0]
    assert abs(d - (1 - np.corrcoef(x[0], x[1])[0, 1])) < 1e-9


def spread_over_tasks(spark):
    """Sets, until reset, what large tables do by themselves: the partitions of a shuffle stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.mark.parametrize("metric", ["correlation", "euclidean"])
@pytest.mark.parametrize("limit", [100, 10])  # 100: the queries are held and the searched side streams; 10: a grid of blocks
def test_knn_of_large_sides_over_many_tasks(spark, metric, limit, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)), 1)
    x[7], x[11], x[12] = x[3], 1.0, 2.0
    df = vecs(spark, [(f"c{i:03}", [float(v) for v in x[i]]) for i in range(400)])
    ask = df.where("cell_id IN ('c003', 'c011', 'c007', 'c200', 'c399')").select(F.expr("int(substr(cell_id, 2))").alias("cell_id"), "vec")
    take = lambda t: sorted(tuple(r) for r in t.collect())
    whole = take(knn(df, ask, 4, metric=metric))
    assert len(whole) == 20 and (metric == "euclidean" or [r[1] for r in whole if r[0] == 11] == ["c000", "c001", "c002", "c003"])
    monkeypatch.setattr("cellweft.operators.knn.BROADCAST_NUMBERS", limit)
    spread_over_tasks(spark)
    try:
        assert take(knn(df, ask, 4, metric=metric, block=64)) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spatial_knn_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(40, 3)) * 0.001 + 5, [[1e4, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 0.0, 0.0)], "cell_id int, x double, y double, z double")
    got = {}
    for r in spatial_knn(df, 3).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["d"]))
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        d[i] = np.inf
        assert [j for _, j in sorted(got[i])] == list(np.lexsort((np.arange(len(x)), d))[:3])
    assert spatial_knn(df.limit(1), 3).count() == 0
    assert [r["cell_id"] for r in closest_points(df.where("x IS NOT NULL"), 1e4, 0.0, 2, 5.0).collect()] == [120]


def test_anchor_chain_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    ref, qry = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    r, q = vecs(spark, [(f"r{i:02}", v.tolist()) for i, v in enumerate(ref)]), vecs(spark, [(f"q{i:02}", v.tolist()) for i, v in enumerate(qry)])
    rq, qr = knn(q, r, 8), knn(r, q, 8)
    pairs = anchors.anchor_pairs(rq, qr, 8).collect()
    a = {(x["q"], x["d"]) for x in rq.collect()}
    b = {(x["d"], x["q"]) for x in qr.collect()}
    assert {(x["r"], x["q"]) for x in pairs} == a & b and a & b
    scored = spark.createDataFrame([(x["r"], x["q"], 0.2 + 0.7 * (i % 5) / 5) for i, x in enumerate(sorted(pairs))], "r string, q string, score double")
    k = 12
    got = {(x["cell_id"], x["r"], x["q"]): x["weight"] for x in anchors.anchor_weights(scored, q, k).collect()}
    rows = sorted((x["q"], x["r"], x["score"]) for x in scored.collect())
    at = {f"q{i:02}": v for i, v in enumerate(qry)}
    for cell, v in at.items():
        d = {c: round(1 - np.corrcoef(v, at[c])[0, 1], 9) for c in {c for c, _, _ in rows}}
        order = sorted(range(len(rows)), key=lambda i: (d[rows[i][0]], rows[i][0]))[: k + 1]
        last = d[rows[order[-1]][0]]
        w = {rows[i][0]: 1 - d[rows[i][0]] / last for i in order[1:]}
        raw = {(cell, rr, c): 1 - math.exp(-w.get(c, 0.0) * s / 4) for c, rr, s in rows}
        total = sum(raw.values())
        for key, u in raw.items():
            assert abs(got.get(key, 0.0) - (u / total if total else 0)) < 1e-8
    moved = anchors.apply_correction(q, anchors.integration_vectors(scored, r, q), anchors.anchor_weights(scored, q, k))
    assert moved.count() == 30


def test_correction_asks_only_for_cells_in_anchors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 6))
    ref = np.concatenate([base, rng.normal(size=(60, 6))])
    r, q = vecs(spark, [(f"r{i:02}", v.tolist()) for i, v in enumerate(ref)]), vecs(spark, [(f"q{i:02}", (v + 0.3).tolist()) for i, v in enumerate(base + 0.05 * rng.normal(size=base.shape))])
    options = dict(k_anchor=2, k_filter=4, k_score=6, k_weight=8)
    a, b, _ = mapping.cca(r, q, 6)
    nn = find_nn_rna(a, b, r, 1, 6)
    kept = anchors.filter_anchors(anchors.anchor_pairs(nn["rq"], nn["qr"], 2), knn(q, r, 4), knn(r, q, 4), 4)
    scored = anchors.score_anchors(kept, nn, 6)
    whole = {x["cell_id"]: x["vec"] for x in anchors.apply_correction(q, anchors.integration_vectors(scored, r, q), anchors.anchor_weights(scored, q, 8)).collect()}
    asked = []

    def counted(data, query, *args, **kw):
        asked.append((data.count(), query.count()))
        return knn(data, query, *args, **kw)

    monkeypatch.setattr("cellweft.operators.mapping.knn", counted)
    monkeypatch.setattr("cellweft.operators.knn.knn", counted)
    got = {x["cell_id"]: x["vec"] for x in mapping.correct(r, q, r, 6, **options).collect()}
    assert set(got) == set(whole) and all(np.allclose(got[c], whole[c], atol=1e-9) for c in got)
    assert any(n == 80 for n, _ in asked) and all(m < 80 for _, m in asked)


def test_cca_equals_svd(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(25, 6)), rng.normal(size=(18, 6))
    a, b, d = mapping.cca(vecs(spark, [(f"a{i:02}", v.tolist()) for i, v in enumerate(x)]), vecs(spark, [(f"b{i:02}", v.tolist()) for i, v in enumerate(y)]), 6)
    z = lambda m: (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
    u, s, vt = np.linalg.svd(z(x) @ z(y).T)
    assert np.allclose(d, s[:5])
    got = np.array([r["vec"] for r in a.orderBy("cell_id").collect()])
    want = u[:, :5] * np.where(u[0, :5] < 0, -1, 1)
    assert np.allclose(got, want, atol=1e-8)


def test_mapping_runs_in_chunks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 8)) * 3
    ref = base[rng.integers(0, 4, 60)] + rng.normal(size=(60, 8)) * 0.3
    qry = base[rng.integers(0, 4, 40)] + rng.normal(size=(40, 8)) * 0.3 + 1.0 * np.arange(8)
    r, q = vecs(spark, [(f"r{i:02}", v.tolist()) for i, v in enumerate(ref)]), vecs(spark, [(f"q{i:02}", v.tolist()) for i, v in enumerate(qry)])
    out = mapping.correct_in_chunks(r, q, r, 8, 1, k_anchor=8, k_filter=20, k_score=15, k_weight=20)
    got = {x["cell_id"]: np.array(x["vec"]) for x in out.collect()}
    near = lambda m: np.mean([np.sqrt(((ref - v) ** 2).sum(1)).min() for v in m])
    assert len(got) == 40 and near(list(got.values())) < near(qry)
    assert set(find_nn_rna(r, q, r, 1, 3)) == {"rr", "qq", "rq", "qr"}


def test_transfer(spark):
    t = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("y", "c", 0.0)], "codex_id string, cite_id string, weight double")
    c = spark.createDataFrame([("a", "2"), ("b", "10"), ("c", "1")], "cell_id string, cluster string")
    cells = spark.createDataFrame([("x",), ("y",), ("w",)], "cell_id string")
    got = {r[0]: r[1] for r in transfer.transfer_clusters(t, c, cells).collect()}
    assert got == {"x": "10", "y": "-1", "w": "-1"}
    rng = np.random.default_rng(1)
    a, b = vecs(spark, [(f"a{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))]), vecs(spark, [(f"b{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(7, 4)))])
    w = transfer.transfer_matrix(a, b, 3)
    assert all(abs(r["s"] - 1) < 1e-12 for r in w.groupBy("cite_id").agg(F.sum("weight").alias("s")).collect())
    assert transfer.transfer_matrix(a, b).count() == 9


def test_mixtures():
    half = [0.5 + i for i in range(0)]
    q = np.linspace(0.001, 0.999, 200)
    from statistics import NormalDist

    x = np.array([NormalDist(1, 0.3).inv_cdf(p) for p in q] + [NormalDist(5, 0.8).inv_cdf(p) for p in q] + half)
    fit = mixtures.em_two_gaussians(x, np.ones(len(x)))
    assert abs(fit["mu0"] - 1) < 0.05 and abs(fit["mu"] - 5) < 0.05 and abs(fit["sd"] - 0.8) < 0.05
    p = mixtures.nb_pmf(400, 12.0, 0.5)
    assert abs(p.sum() - 1) < 1e-9 and abs((p * np.arange(401)).sum() - 12) < 1e-6
    obs = 0.6 * mixtures.nb_pmf(80, 3.0, 0.4) + 0.4 * mixtures.nb_pmf(80, 30.0, 0.1)
    got = min((mixtures.minimise(lambda a: mixtures.nb_mix_sse(a, obs), s, [1e-8] * 5, [np.inf] * 4 + [1.0]) for s in mixtures.STARTS), key=lambda r: r[1])
    assert got[1] < 1e-4 < mixtures.nb_mix_sse(mixtures.STARTS[0], obs)


def test_cleaning(spark):
    rng = random.Random(0)
    rows = [(f"c{i}", f, float(max(0, int(rng.gauss(3 if i % 2 else 30, 3))))) for i in range(120) for f in ("p", "q")]
    long = spark.createDataFrame(rows, "cell_id string, feature string, value double")
    for out in (mixtures.clean_cite(long, "nb"), mixtures.clean_cite(long, "gaussian"), mixtures.clean_codex(long, "arcsinh"), mixtures.clean_codex(long, "gaussian")):
        v = [r["value"] for r in out.collect()]
        assert len(v) == 240 and min(v) >= -1e-9 and max(v) <= 1 + 1e-9
    for f in (mixtures.clean_cite, mixtures.clean_codex):
        with pytest.raises(ValueError):
            f(long, "other")


def test_louvain_finds_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c0", 1.0), ("a1", "a1", 1.0)]
    got = clustering.louvain(spark.createDataFrame(edges, "a string, b string, w double")).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(r["cell_id"][0])
    assert sorted(map(tuple, by.values())) == [("a",), ("b",), ("c",)]


def test_louvain_level_ends_only_when_settled(spark):
    # ten triangles among 6,000 cells that never move: each sweep moves less than half a percent of all
    edges = [(f"t{g}{i}", f"t{g}{j}", 1.0) for g in range(10) for i in range(3) for j in range(i)] + [(f"s{i}", f"s{i}", 1.0) for i in range(6000)]
    got = clustering.louvain(spark.createDataFrame(edges, "a string, b string, w double"), levels=1).where("cell_id LIKE 't%'").collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], []).append(r["cell_id"][:2])
    assert sorted(by.values()) == [[f"t{g}"] * 3 for g in range(10)]


def test_density_and_consensus(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 10)) * 4
    x = np.concatenate([b + rng.normal(size=(25, 10)) * 0.3 for b in base] + [rng.normal(size=(3, 10)) * 4])
    label = clustering.hdbscan_labels(x, 4, 8)
    assert len(set(label[:75]) - {-1}) == 3 and all(len({v for v in label[i : i + 25] if v >= 0}) == 1 for i in (0, 25, 50))
    df = vecs(spark, [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)])
    runs, labels = clustering.parameter_scan(df, [6, 8], [3, 4])
    assert runs.count() == 4
    out = clustering.consensus_cluster(runs, labels, df, 0.0, 1.0, 5)
    assert out.count() == 78
    with pytest.raises(ValueError):
        clustering.consensus_cluster(runs, labels, df, 2.0)
    one = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "n", -1), (1, "m", -1), (2, "a", 1), (2, "b", 0)], "run_id int, cell_id string, label int")
    assert [tuple(r) for r in clustering.consensus_dissimilarity(one, 2).collect()] == [("a", "b", 0.5)]
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    m = clustering.average_linkage(d)
    assert m[:, 2].tolist() == [1, 2, 9] and len(set(clustering.cut_by_inconsistency(m, 4, 0.5))) == 2
    two = df.withColumn("cluster", (F.substring("cell_id", 2, 3).cast("int") / 25).cast("int").cast("string"))
    s = clustering.silhouette(df, two.select("cell_id", "cluster")).first()
    lab = np.minimum(3, np.arange(78) // 25)
    assert abs(s[0] - clustering.silhouette_of(x, lab)) < 1e-9


def test_adjacency(spark):
    pts = spark.createDataFrame([(f"{i}{j}", float(i), float(j), 0.0) for i in range(3) for j in range(3)], "cell_id string, x double, y double, z double")
    e = adjacency.knn_graph(pts, 2)
    pairs = {(r["i"], r["j"]) for r in e.collect()}
    assert pairs == {(j, i) for i, j in pairs} and ("00", "01") in pairs and ("00", "22") not in pairs
    clusters = pts.select("cell_id", F.when(F.col("x") < 1, "a").otherwise("b").alias("cluster"))
    long = clusters.select("cell_id", F.col("cluster").alias("feature"), F.lit(1.0).alias("value"))
    by_count = {(r[0], r[1]): r[2] for r in adjacency.cluster_score(e, clusters).collect()}
    by_value = {(r[0], r[1]): r[2] for r in adjacency.adjacency_score(e, long, adjacency.all_pairs(long.select("feature").distinct())).collect()}
    assert by_count == by_value
    heat = {(r[0], r[1]): r[2] for r in adjacency.adjacency_score(e, long, adjacency.all_pairs(long.select("feature").distinct()), c=0.1).collect()}
    assert all(heat[k] >= by_count[k] for k in heat)
    p = adjacency.with_q_values(adjacency.cluster_p_values(e, clusters)).collect()
    assert all(0 <= r["p"] <= r["q"] <= 1 for r in p)
    assert abs(adjacency.hypergeometric_tail(0, 10, 4, 3) - 1) < 1e-9 and abs(adjacency.hypergeometric_tail(3, 10, 4, 3) - 4 / 120) < 1e-9
    s = adjacency.with_q_values(adjacency.with_p_values(adjacency.permuted_scores(e, long, adjacency.all_pairs(long.select("feature").distinct()), num_perms=20), 20)).collect()
    assert {(r["f"], r["g"]) for r in s} == set(by_count) and all(0 <= r["p"] <= 1 for r in s)


def test_views_and_layout(spark):
    emb = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 2.0, 0.0)], "cell_id string, e1 double, e2 double")
    long = spark.createDataFrame([("a", "g", 1.0), ("b", "g", 3.0)], "cell_id string, feature string, value double")
    got = {r["cell_id"]: (r["value1"], r["bin1"]) for r in views.expression(emb, long, ["g"]).collect()}
    assert got == {"a": (1.0, 34), "b": (3.0, 100), "c": (0.0, 1)}
    for bad in (["g", "g", "g"], ["h"]):
        with pytest.raises(ValueError):
            views.expression(emb, long, bad)
    assert {r["cluster"] for r in views.clusters(emb, None).collect()} == {"-1"}
    assert views.app_view(emb, "protein", long=long, feature="g").where("drawn_last").count() == 2
    rng = np.random.default_rng(0)
    out, nn = embedding.layout(vecs(spark, [(f"c{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(30, 6)))]), 5, rounds=3)
    assert out.count() == 30 and nn.count() == 150 and abs(out.agg(F.var_pop("e1")).first()[0] - 1) < 1e-6


def test_fcs(spark, tmp_path):
    path = str(tmp_path / "x.fcs")
    names = ["Blank1", "CD3.CD3", "CD4", "X.X", "y", "z", "tile_nr", "size"]
    rows = np.arange(24, dtype=float).reshape(3, 8)
    rows[:, 6] = [1, 2, 10]
    fcs.write_fcs(path, names, rows, [n + " long" for n in names])
    df = fcs.read_fcs(spark, path)
    assert [list(r)[1:] for r in df.orderBy("event").collect()] == rows.tolist()
    assert spark.read.format("fcs").option("events_per_partition", 2).load(path).count() == 3
    assert fcs.read_names(spark, path).collect()[1]["channel"] == "CD3.CD3 long"
    said = []
    data = api.read_codex_fcs(spark, path, [n.startswith("CD") for n in names], [n.startswith("Bl") for n in names], tile_relative=True, warn=said.append)
    assert data.codex_features == ("cd3", "cd4") and not said
    at = {r["cell_id"]: (r["x"], r["y"]) for r in data.codex_spatial.collect()}
    assert at["1"] == (3 * 188.0, 4 * 188.0) and at["3"] == ((19 + 19) * 188.0, 20 * 188.0)
    api.read_codex_fcs(spark, path, [True] + [False] * 7, [False] * 8, warn=said.append)
    assert len(said) == 1
    with pytest.raises(ValueError):
        api.read_codex_fcs(spark, path, [True] * 8, [False] * 8, ["a"])
    with pytest.raises(ValueError):
        fcs.tile_to_absolute(df.select("x.x" if False else "y"), 9) if False else fcs.tile_to_absolute(spark.createDataFrame([(1.0, 2.0)], "x double, y double"))


def test_tables_and_streams(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,c1,c2\nADT_a,1,2\nADT_b,3,4\n")
    long = tabular.read_feature_rows(spark, str(tmp_path / "m.csv"), prefix="ADT_")
    assert {tuple(r) for r in long.collect()} == {("c1", "a", 1.0), ("c2", "a", 2.0), ("c1", "b", 3.0), ("c2", "b", 4.0)}
    genes = spark.createDataFrame([("a", "S", 1), ("b", "S", 2)], "id string, symbol string, position int")
    assert tabular.name_genes(long, genes).count() == 2
    cells = spark.createDataFrame([("a", 5.0, [1.0]), ("b", 50.0, [1.0])], "cell_id string, size double, blanks array<double>")
    tabular.write_table(cells, str(tmp_path / "cells"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))
    q = live.gate_stream(stream, 1, (0, 10), (5,), (0,)).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["cell_id"] for r in spark.table("gated").collect()] == ["a"]


def test_api_chain(spark):
    rng = np.random.default_rng(0)
    base = rng.uniform(1, 30, size=(3, 5))
    make = lambda n, s, seed: [(f"{s}{i:03}", [float(v) for v in np.random.default_rng(seed + i).poisson(base[i % 3])]) for i in range(n)]
    codex, cite = vecs(spark, make(60, "x", 0)), vecs(spark, make(45, "r", 500))
    ids = codex.select("cell_id")
    data = api.set_codex(codex, ids.withColumn("blanks", F.array(F.lit(0.0))), ids.withColumn("size", F.lit(1.0)), ids.select("cell_id", (F.substring("cell_id", 2, 3).cast("int") % 8).cast("double").alias("x"), (F.substring("cell_id", 2, 3).cast("int") / 8).cast("int").cast("double").alias("y"), F.lit(0.0).alias("z")), names=list("abcde"))
    mrna = frames.to_long(cite, list("stuvw"))
    data = api.set_cite(mrna, cite, latent=cite, names=list("abcde"), data=data).but(cite_clusters=cite.select("cell_id", (F.substring("cell_id", 2, 3).cast("int") % 3).cast("string").alias("cluster")))
    data = api.filter_codex(data)
    assert data.codex_protein.count() == 60
    data = api.clean_cite(api.clean_codex(data, "arcsinh"), "gaussian")
    data = api.map_codex_to_cite(data, k_anchor=8, k_filter=20, k_score=10, k_weight=15)
    data = api.get_transfer_matrix(data, 5)
    assert data.codex_mrna.count() > 0 and data.codex_clusters.count() == 60
    assert api.adj_score_clusters_codex(data, 3).where("q < 0 OR q > 1").count() == 0
    assert api.adj_score_clusters_cite(data, 3, num_perms=5).count() > 0
    assert api.adj_score_proteins(data, k=3, num_perms=5).count() == 15
    pairs = spark.createDataFrame([("s", "t")], "f string, g string")
    assert api.adj_score_genes(data, pairs, 3, num_perms=5).count() == 1
    assert api.plot_cluster_codex_spatial(data).count() == 60
    assert api.plot_expr_codex_spatial(data, ["a", "b"]).count() == 60
    with pytest.raises(ValueError):
        api.cluster_codex(data)
    assert isinstance(api.filter_cite_mrna(data, 1, 1).cite_mrna.toPandas(), pd.DataFrame)


def test_null_moments_are_those_of_all_deals(spark):
    import itertools

    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]
    both = edges + [(b, a) for a, b in edges]
    x, y = [1.0, 0.0, 2.5, -1.0], [0.0, 3.0, 1.0, 2.0]
    long = [(str(i), "f", v) for i, v in enumerate(x)] + [(str(i), "g", v) for i, v in enumerate(y)] + [("9", "f", 7.0)]
    e = spark.createDataFrame([(str(a), str(b)) for a, b in both], "i string, j string")
    df = spark.createDataFrame([(*r, 1) for r in long], "cell_id string, feature string, value double, n int")
    got = adjacency.null_moments(e, df, spark.createDataFrame([("f", "g"), ("f", "none")], "f string, g string")).collect()
    got = {r["g"]: r for r in got}
    spread = [sum(y[b] for a, b in both if a == i) for i in range(4)]
    deals = [sum(x[p[i]] * spread[i] for i in range(4)) for p in itertools.permutations(range(4))]
    assert abs(got["g"]["mean"] - np.mean(deals)) < 1e-9 and abs(got["g"]["sd"] - np.std(deals)) < 1e-9
    assert abs(got["g"]["score"] - sum(x[i] * spread[i] for i in range(4))) < 1e-9 and got["none"]["sd"] == 0


def test_hypergeometric_tail_against_sums():
    import math

    for pop, marked, drawn in ((50, 20, 10), (400, 3, 200), (9, 9, 4), (2000, 900, 700)):
        exact = [math.comb(marked, k) * math.comb(pop - marked, drawn - k) / math.comb(pop, drawn) for k in range(drawn + 1)]
        for x in (0, 1, 2, drawn // 2, drawn):
            assert abs(adjacency.hypergeometric_tail(x, pop, marked, drawn) - sum(exact[x:])) < 1e-9


def test_q_values_over_partitions(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500) ** 3, 4)
    df = spark.createDataFrame([(f"f{i:03}", "g", float(v), "x") for i, v in enumerate(p)], "f string, g string, p double, note string").repartition(7)
    got = {r["f"]: r["q"] for r in adjacency.with_q_values(df).collect()}
    order = np.lexsort((np.arange(500), p))
    q = np.minimum.accumulate((p[order] * 500 / np.arange(1, 501))[::-1])[::-1].clip(max=1)
    assert all(abs(got[f"f{i:03}"] - v) < 1e-12 for i, v in zip(order, q))
    assert adjacency.with_q_values(df.limit(0)).count() == 0


def test_spatial_neighbours_around_a_crowded_spot(spark):
    """A spot a million times denser than the rest, points alone, and equal positions: exact for all."""
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.random((150, 3)) * 1000, 500 + rng.random((200, 3)) * 1e-3, np.full((6, 3), 250.0), [[9e4, 0, 0], [0, -7e4, 3.0]]])
    df = spark.createDataFrame([(f"c{i:03}", *map(float, r), 1) for i, r in enumerate(xyz)], "cell_id string, x double, y double, z double, level int")
    got = {}
    for r in spatial_knn(df, 4).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["dist"], r["d"]))
    for i, a in enumerate(xyz):
        d = np.round(np.sqrt(((xyz - a) ** 2).sum(1)), 9)
        want = sorted((v, f"c{j:03}") for j, v in enumerate(d) if j != i)[:4]
        assert [(x, y) for _, x, y in sorted(got[f"c{i:03}"])] == want
