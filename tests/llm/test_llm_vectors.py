import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweft.llm.percentiles import bisect_percentiles, combine, summarise
from cellweft.llm.similar_vectors import Hashing, similar_vectors, sketch, sketch_limit, tuned, unit
from cellweft.llm.similarity_clusters import Sets, bridges, components, jaccard, similarity_clusters, star_links

VEC = "id string, vec array<double>, rep string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VEC)


def mixed(n=240, dim=12, kinds=4, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds, dim))
    kind = rng.integers(0, kinds, n)
    return base[kind] + rng.normal(size=(n, dim)) * spread, kind


def dirty(dim):
    return [("n1", None), ("n2", [1.0]), ("n3", [2.0] * dim), ("n4", [1.0] * (dim - 1) + [None]), ("n5", [1.0] * (dim - 1) + [math.nan]), (None, list(map(float, range(dim))))]


def test_neighbours_recall_copies_and_order(spark):
    x, _ = mixed()
    rows = [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)]
    rows += rows[:10] + [(f"t{i}", x[0].tolist()) for i in range(9)] + dirty(12)
    h = Hashing(tables=6, hashes=4, width=1.2, probes=8)
    got = {}
    for r in similar_vectors(table(spark, rows), "id", "vec", 12, k=5, hashing=h, chunk=32).collect():
        got.setdefault(r["query_id"], []).append((r["nn_rank"], r["neighbour_id"], r["nn_dist"]))
    ids = [f"c{i:03}" for i in range(240)] + [f"t{i}" for i in range(9)]
    z = unit(np.concatenate([x, np.repeat(x[:1], 9, 0)]))
    hit = 0
    for a, i in enumerate(ids):
        near = sorted(got[i])
        assert [k for k, _, _ in near] == [1, 2, 3, 4, 5] and i not in {n for _, n, _ in near}
        d = 1 - z @ z[a]
        for _, n, dist in near:
            assert abs(d[ids.index(n)] - dist) < 1e-9
        d[a] = 9
        want = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:5]
        hit += len({ids[j] for j in want} & {n for _, n, _ in near})
    assert hit >= 0.9 * 5 * len(ids)
    assert sorted(got["t0"])[0][1] == "c000" and all(d < 1e-12 for _, _, d in got["t0"])
    assert set(got) == set(ids)


def test_neighbours_within_distance_and_marked_queries(spark):
    x, _ = mixed(seed=3)
    near = x[:30] + np.random.default_rng(1).normal(size=(30, 12)) * 0.001
    rows = [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)] + [(f"m{i:03}", v.tolist()) for i, v in enumerate(near)]
    h = Hashing(tables=3, hashes=8, width=0.6, probes=4)
    got = {(r["query_id"], r["neighbour_id"]) for r in similar_vectors(table(spark, rows), "id", "vec", 12, k=5, max_distance=0.001, hashing=h).collect()}
    pairs = {(f"c{i:03}", f"m{i:03}") for i in range(30)}
    assert got == pairs | {(b, a) for a, b in pairs}
    asked = similar_vectors(table(spark, rows), "id", "vec", 12, k=2, queries=F.col("id").startswith("m"), hashing=Hashing(4, 3, 1.5, 4)).collect()
    assert {r["query_id"] for r in asked} == {f"m{i:03}" for i in range(30)} and all(r["nn_rank"] <= 2 for r in asked)
    assert similar_vectors(table(spark, dirty(12)), "id", "vec", 12, k=5, hashing=h).count() == 0


def test_sketches_pass_over_no_pair_within_the_limit():
    rng = np.random.default_rng(5)
    for dim in (3, 9, 30):
        z = unit(rng.standard_normal((4000, dim)))
        step = rng.standard_normal(z.shape) * 0.02
        y = unit(z + step)
        dist = 1 - (z * y).sum(1)
        a, b = (sketch(x).view(np.int8).reshape(-1, 8).astype(float) for x in (z, y))
        apart = ((a - b) ** 2).sum(1)
        for limit in (1e-5, 1e-3, 1e-2):
            assert (apart[dist <= limit] <= sketch_limit(limit)).all()


@pytest.mark.parametrize("n", [200, 2000, 20000])
def test_tuned_tables_hold_the_recall_at_every_size(spark, n):
    """Measured by brute force for queries that the tuning did not see; the recall does not fall as rows grow."""
    x = mixed(n, 12, 6, seed=n)[0]
    df = table(spark, [(f"c{i:06}", v.tolist()) for i, v in enumerate(x)])
    every = F.xxhash64("id") % max(1, n // 200) == 0
    hashing = tuned(df, "id", "vec", 12, queries=every, sample=150)
    z = unit(x)
    got = {}
    for r in similar_vectors(df, "id", "vec", 12, k=5, queries=every, hashing=hashing).collect():
        got.setdefault(int(r["query_id"][1:]), set()).add(int(r["neighbour_id"][1:]))
    same = all_ = 0
    for r in df.where(every).select("id").collect():
        q = int(r["id"][1:])
        want = [j for j in np.argsort(1 - z @ z[q], kind="stable")[:6] if j != q][:5]
        same, all_ = same + len(got.get(q, set()) & set(want)), all_ + len(want)
    assert same / all_ >= 0.9
    assert tuned(df.limit(0), "id", "vec", 12).tables and tuned(df.limit(1), "id", "vec", 12).tables


def test_perturbations_come_in_order_of_success():
    t = Hashing(tables=1, hashes=5, width=1.0, probes=30).template()
    m = 5
    expect = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    score = [sum(expect[j] for j in s) for s in t]
    assert score == sorted(score) and len(set(t)) == 30 and all(2 * m - 1 - j not in s for s in t for j in s)


def test_clusters_sizes_and_outliers(spark):
    x, kind = mixed(n=600, dim=24, kinds=4, spread=0.2)
    far = np.random.default_rng(9).normal(size=(5, 24))
    rows = [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)] + [("c000", x[0].tolist())] + [(f"f{i}", v.tolist()) for i, v in enumerate(far)] + dirty(24)
    rows += [(f"copy{i}", x[1].tolist()) for i in range(300)]
    got = similarity_clusters(table(spark, rows), "id", "vec", 24, sets=Sets(min_share=0.02)).collect()
    at = {r["id"]: r["cluster"] for r in got}
    assert len(got) == 600 + 5 + 300
    of = {k: {at[f"c{i:03}"] for i in range(600) if kind[i] == k} for k in range(4)}
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == 4
    assert {at[f"copy{i}"] for i in range(300)} == {at["c001"]}
    assert similarity_clusters(table(spark, dirty(24)), "id", "vec", 24).count() == 0


def test_star_links_against_loop():
    rng = np.random.default_rng(0)
    t = rng.random((60, 64)) < 0.5
    t[30:] = t[:30] ^ (rng.random((30, 64)) < 0.06)
    block = np.sort(rng.integers(0, 4, 60))
    weight = np.concatenate([np.sort(rng.integers(1, 9, n))[::-1] for n in np.bincount(block)])
    words = np.packbits(t, axis=1).view(np.uint64)
    a, b = star_links(words, block, weight, 0.6)
    got = dict(zip(a.tolist(), b.tolist()))
    sim = jaccard(t, t)
    for g in range(4):
        leaders = []
        for i in np.flatnonzero(block == g):
            like = [j for j in leaders if sim[i, j] >= 0.6]
            assert got.get(int(i)) == (like[0] if like else None)
            if not like:
                leaders.append(i)


@pytest.mark.parametrize("few", [64, 5])  # 5: star by star
def test_stars_and_bridges_connect_all_similar_pairs(few):
    rng = np.random.default_rng(3)
    t = rng.random((90, 64)) < 0.5
    for i in range(4, 90):  # chains: each is like the one before it, not like all of them
        t[i] = t[i - 4] ^ (rng.random(64) < 0.12)
    block, n = np.sort(rng.integers(0, 3, 90)), np.ones(90, np.int64)
    words, sim = np.packbits(t, axis=1).view(np.uint64), jaccard(t, t)

    def groups(pairs):
        name = list(range(90))
        for i, j in pairs:
            name = [min(name[i], name[j]) if x in (name[i], name[j]) else x for x in name]
        return name

    x, y = star_links(words, block, n, 0.6)
    lead = np.arange(90)
    lead[x] = y
    u, v = bridges(words, block, lead, 0.6, few=few)
    assert all(block[i] == block[j] and sim[i, j] >= 0.6 for i, j in zip(u, v))
    whole = groups([(i, j) for i in range(90) for j in range(i) if block[i] == block[j] and sim[i, j] >= 0.6])
    assert groups(zip(x, y)) != whole == groups([*zip(x, y), *zip(u, v)])
    assert len(bridges(words[:0], block[:0], lead[:0], 0.6)[0]) == 0


def test_components_in_rounds_are_those_of_one_task(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(150), rng.randrange(150)) for _ in range(90)], "a long, b long")
    one, rounds = (sorted(tuple(r) for r in components(edges, few=n).collect()) for n in (1_000_000, 0))
    assert one == rounds


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200 + rng.randrange(9), 200 + rng.randrange(9)) for _ in range(30)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(round(p * len(v), 9))) - 1]


NUM = "g string, day int, v double, p string, value string"
PS = [0.0, 0.1, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_percentiles_with_dirty_rows(spark, monkeypatch, limit):
    monkeypatch.setattr("cellweft.session.BROADCAST_ROWS", limit)  # 0: groups are dealt over tasks
    rng = random.Random(0)
    rows = [("big", rng.randrange(5), rng.lognormvariate(0, 3)) for _ in range(3000)] + [("tie", 0, 4.0)] * 50 + [("two", 1, -1.0), ("two", 2, 1e300), (None, 1, 5.0)]
    rows += [("inf", 0, v) for v in (math.inf, -math.inf, 1.0, 2.0, 3.0)] + [("big", 0, None), ("big", 0, math.nan), ("nul", 0, None)] + [("zero", 0, 0.0), ("zero", 0, -0.0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], NUM)
    by = {}
    for g, _, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    for finish, sections in ((1, 16), (1000, 64)):
        got = {(r["g"], r["p"]): r for r in bisect_percentiles(df, ["g"], "v", PS, finish=finish, sections=sections).collect()}
        assert set(got) == {(g, p) for g in by for p in PS}
        for (g, p), r in got.items():
            assert r["value"] == exact(by[g], p) and r["n"] == len(by[g])
    near = bisect_percentiles(df.where("g = 'big'"), ["g"], "v", [0.5], finish=1, max_error=0.5).first()
    assert near["low"] <= exact(by["big"], 0.5) <= near["high"] and near["high"] - near["low"] <= 0.5
    assert bisect_percentiles(df.limit(0), ["g"], "v", PS).count() == 0
    with pytest.raises(ValueError):
        bisect_percentiles(df, ["g"], "v", [2.0])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_percentiles_property(spark, values):
    df = spark.createDataFrame([("a", 0, v, "", "") for v in values], NUM)
    got = {r["p"]: r["value"] for r in bisect_percentiles(df, ["g"], "v", PS, finish=1, sections=8).collect()}
    assert got == {p: exact(values, p) for p in PS}


def test_days_combine_within_bound(spark):
    rng = random.Random(5)
    rows = [("a", d, rng.gauss(d, 1 + d)) for d in range(6) for _ in range(50 * (d + 1))]
    df = spark.createDataFrame([(*r, "", "") for r in rows], NUM)
    values = sorted(v for _, _, v in rows)
    for r in combine(summarise(df, ["g"], "day", "v", points=20), ["g"], [0.1, 0.5, 0.9]).collect():
        rank = sum(v <= r["value"] for v in values)
        assert abs(rank - r["p"] * len(values)) <= len(values) / 20 + 6
        assert r["n"] == len(values)


def test_clusters_with_near_centres_stay_apart(spark):
    rng = np.random.default_rng(4)
    sign = rng.choice([-1.0, 1.0], 30)
    other = sign.copy()
    other[:10] *= -1  # two thirds of the profile is shared
    far = rng.choice([-1.0, 1.0], 30)
    base = np.stack([sign, other, far])
    kind = rng.choice(3, 900, p=[0.6, 0.3, 0.1])
    x = base[kind] * rng.uniform(0.6, 1.4, (900, 30)) + rng.normal(size=(900, 30)) * 0.3
    got = {r["id"]: r["cluster"] for r in similarity_clusters(table(spark, [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)]), "id", "vec", 30).collect()}
    of = [{got[f"c{i:03}"] for i in range(900) if kind[i] == k} for k in range(3)]
    assert all(len(v) == 1 for v in of) and len(set.union(*of)) == 3


def test_id_with_several_vectors_keeps_classes_apart(spark):
    rng = np.random.default_rng(7)
    v1, v2, far = rng.normal(size=(3, 12))
    near2 = v2 + rng.normal(size=12) * 1e-4
    rows = [("a", v1.tolist()), ("a", v2.tolist()), ("m", v1.tolist()), ("q", near2.tolist()), ("z", far.tolist())]
    got = {(r["query_id"], r["neighbour_id"]): r["nn_dist"] for r in similar_vectors(table(spark, rows), "id", "vec", 12, k=5, max_distance=0.001, hashing=Hashing(3, 6, 0.6, 4)).collect()}
    assert set(got) == {("a", "m"), ("m", "a"), ("a", "q"), ("q", "a")}
    assert got["a", "m"] < 1e-12 < got["a", "q"]


def test_small_clusters_keep_a_medoid(spark):
    rng = np.random.default_rng(2)
    sign = rng.choice([-1.0, 1.0], 30)
    beside = sign.copy()
    beside[:11] *= -1  # like the large cluster from `member` on, but apart from it
    far = rng.choice([-1.0, 1.0], (2, 30))
    base, size = np.stack([sign, far[0], beside, far[1]]), [9000, 9000, 30, 30]  # 30 rows are under 0.2 % of all
    kind = np.repeat(np.arange(4), size)
    x = base[kind] * rng.uniform(0.6, 1.4, (len(kind), 30)) + rng.normal(size=(len(kind), 30)) * 0.3
    tokens = lambda v: Sets().tokens(unit(v))
    lone = next(v for v in rng.normal(size=(99, 1, 30)) if jaccard(tokens(v), tokens(x)).max() < 0.4)
    rows = [(f"c{i:05}", v.tolist()) for i, v in enumerate(x)] + [("lone", lone[0].tolist())]
    got = {r["id"]: r["cluster"] for r in similarity_clusters(table(spark, rows), "id", "vec", 30).collect()}
    assert None not in got.values() and len(got) == len(rows)
    of = [{got[f"c{i:05}"] for i in np.flatnonzero(kind == k)} for k in range(4)]
    assert all(len(v) == 1 for v in of) and len(set.union(*of)) == 4
    assert got["lone"] not in set.union(*of)


def test_clusters_do_not_depend_on_the_chunk(spark):
    x, _ = mixed(n=900, dim=24, kinds=3, spread=0.45, seed=5)
    t = table(spark, [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)])
    whole, parts = ({tuple(r) for r in similarity_clusters(t, "id", "vec", 24, sets=Sets(min_share=0.05), chunk=n).collect()} for n in (4096, 16))
    assert whole == parts
