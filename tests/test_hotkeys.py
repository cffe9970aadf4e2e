import math
import random

import pytest
from pyspark.sql import functions as F

from cellweft.operators.hotkeys import compress, heavy_keys, keyed_means, profile, quantiles_interpolated, salted_join, weighted_percentiles
from cellweft.session import parse_cluster, spread


def test_labels_in_all_spellings(spark):
    rows = ["4", "004", "4.0", "c4", "C04", "cluster_4", "-1", "-1.0", "NA", "", None, "x4", "4x", " 4 "]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select(parse_cluster("s").alias("n"))
    assert [r[0] for r in df.collect()] == [4, 4, 4, 4, 4, 4, -1, -1, None, None, None, None, None, 4]


def hot(spark):
    rng = random.Random(0)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [(f"k{i % 7}", rng.gauss(0, 1)) for i in range(400)]
    rows += [("hot", None), ("none", None), (None, 1.0), ("nan", math.nan), ("tie", 2.0), ("tie", 1.0)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "key string, v double, weight string")


@pytest.mark.parametrize("limit", [50_000, 0])
def test_profile(spark, monkeypatch, limit):
    monkeypatch.setattr("cellweft.session.BROADCAST_ROWS", limit)  # 0: keys are dealt over tasks
    rows, df = hot(spark)
    got = {r["key"]: r for r in profile(compress(df, ["key"], "v"), ["key"]).collect()}
    h = [v for k, v in rows if k == "hot"]
    assert got["hot"]["rows"] == len(h) and got["hot"]["value_rows"] == len(h) - 1
    counts = {v: h.count(v) for v in set(h) - {None}}
    assert got["hot"]["distinct_values"] == len(counts)
    assert got["hot"]["mode"] == min(v for v in counts if counts[v] == max(counts.values()))
    assert got["none"]["distinct_values"] == 0 and got["none"]["mode"] is None
    assert got["tie"]["mode"] == 1.0


@pytest.mark.parametrize("block", [5, 50_000])
def test_percentiles_are_exact(spark, block):
    rows, df = hot(spark)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["key"], r["p"]): r["value"] for r in weighted_percentiles(compress(df, ["key"], "v"), ["key"], ps, block=block, splitters=8).collect()}
    for k in {k for k, _ in rows if k}:
        vs = sorted(v for q, v in rows if q == k and v is not None and v == v)
        for p in ps:
            if vs:
                assert got[k, p] == vs[max(1, math.ceil(round(p * len(vs), 9))) - 1]
            else:
                assert (k, p) not in got
    with pytest.raises(ValueError):
        weighted_percentiles(compress(df, ["key"], "v"), ["key"], [1.5])


def test_interpolated_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8)], "key string, v double")
    got = {r["p"]: r["value"] for r in quantiles_interpolated(compress(df, ["key"], "v"), ["key"], [0.0, 0.5, 0.9]).collect()}
    assert got[0.0] == 1 and got[0.5] == 3 and abs(got[0.9] - 6.8) < 1e-12


def test_heavy_means_and_salted_join(spark):
    rows, df = hot(spark)
    assert [r["key"] for r in heavy_keys(compress(df, ["key"], F.lit(1)), "key", 0.5).collect()] == ["hot"]
    mean = {r["key"]: r["v"] for r in keyed_means(df, ["key"], ["v"]).collect()}
    assert mean["tie"] == 1.5 and mean["nan"] is None
    names = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, name int")
    big = df.select("key", "v")
    got = salted_join(big, names, "key", hot_rows=100, salts=4)
    assert got.count() == big.join(names, "key").count()
    assert salted_join(big, names, "key", how="left", hot_rows=100).count() == big.count()


def test_empty(spark):
    df = spark.createDataFrame([], "key string, v double")
    w = compress(df, ["key"], "v")
    assert profile(w, ["key"]).count() == 0
    assert weighted_percentiles(w, ["key"], [0.5]).count() == 0
    assert heavy_keys(w, "key", 0.1).count() == 0


def test_a_key_of_nine_tenths_is_dealt_over_tasks(spark, monkeypatch):
    """Without broadcasts no task of the join reads over twice the mean."""
    monkeypatch.setattr("cellweft.session.BROADCAST_ROWS", 0)
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"), "id")
    marks = df.groupBy("key").count()
    hinted = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        big, few, salt = spread(df, marks)
        assert salt
        joined = big.join(few, ["key", *salt])
        per = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per) == 40_000 and max(per) < 2 * 40_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in hinted.items():
            spark.conf.set(k, v)
