import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellweft.operators.spatial import near_pairs, near_pairs_on_earth, points_in_regions

PT = "id string, grp string, x double, y double, z double, left_id string, _key long"


def brute(rows, r):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        if None in a[:5] or None in b[:5] or any(v != v for v in a[2:5] + b[2:5]):
            continue
        if a[1] == b[1] and a[0] != b[0] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= r * r:
            out.add((a[1], *sorted((a[0], b[0]))))
    return out


def points(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PT)


def test_near_pairs_with_dirty_rows(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(60)}", rng.choice("ab"), rng.uniform(0, 10), rng.uniform(-5, 5), rng.uniform(0, 2)) for _ in range(200)]
    rows += rows[:20] + [("n", None, 1.0, 1.0, 1.0), (None, "a", 1.0, 1.0, 1.0), ("q", "a", None, 1.0, 1.0), ("w", "a", float("nan"), 1.0, 1.0)]
    rows += [(f"t{i}", "a", 3.0, 3.0, 1.0) for i in range(5)]
    got = {tuple(r) for r in near_pairs(points(spark, rows), 1.0).collect()}
    assert got == brute(rows, 1.0)


def test_crowded_cell_is_cut_into_blocks(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03}", "a", rng.random(), rng.random(), 0.0) for i in range(150)]
    assert {tuple(r) for r in near_pairs(points(spark, rows), 0.9, block=16).collect()} == brute(rows, 0.9)


def test_near_pairs_empty(spark):
    assert near_pairs(points(spark, []), 1.0).count() == 0
    with pytest.raises(ValueError):
        near_pairs(points(spark, []), 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.just("g"), *[st.integers(-4, 4).map(float)] * 3), max_size=14))
def test_near_pairs_property(spark, rows):
    rows = [(i, g, x + 0.01, y, z) for i, g, x, y, z in rows]
    assert {tuple(r) for r in near_pairs(points(spark, rows), 2.5).collect()} == brute(rows, 2.5)


def test_on_earth_over_pole_and_date_line(spark):
    rows = [("a", "g", 0.0, 179.9999), ("b", "g", 0.0, -179.9999), ("c", "g", 89.9999, 0.0), ("d", "g", 89.9999, 180.0), ("e", "g", 10.0, 10.0), ("f", "g", 95.0, 10.0)]
    df = spark.createDataFrame(rows, "id string, grp string, lat double, lon double")
    got = {(r[1], r[2]) for r in near_pairs_on_earth(df, 30.0).collect()}
    assert got == {("a", "b"), ("c", "d")}


def test_regions(spark):
    square = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])
    closed = ([0.0, 0.0, 4.0, 4.0, 0.0], [0.0, 4.0, 4.0, 0.0, 0.0])
    notch = ([0.0, 4.0, 4.0, 2.0, 0.0], [0.0, 0.0, 4.0, 1.0, 4.0])
    big = ([-1e6, 1e6, 1e6, -1e6], [-1e6, -1e6, 1e6, 1e6])
    regions = [("sq", "s", *square), ("cl", "s", *closed), ("no", "s", *notch), ("big", "s", *big), ("else", "t", *square), ("two", "s", [0.0, 1.0], [0.0, 1.0]), ("nul", "s", [0.0, None, 4.0], [0.0, 0.0, 4.0]), ("nil", None, *square), ("odd", "s", [0.0, 4.0, 4.0], [0.0, 4.0])]
    r = spark.createDataFrame(regions, "area_id string, slide_id string, poly_x array<double>, poly_y array<double>")
    p = points(spark, [("in", "s", 2.0, 2.0, 0.0), ("low", "s", 2.0, 0.5, 0.0), ("out", "s", 9.0, 9.0, 0.0), ("low", "s", 2.0, 0.5, 0.0), ("nan", "s", math.nan, 0.5, 0.0), ("none", None, 2.0, 2.0, 0.0)])
    got = {(x[1], x[2]) for x in points_in_regions(p, r).collect()}
    assert got == {("in", "sq"), ("in", "cl"), ("in", "big"), ("low", "sq"), ("low", "cl"), ("low", "no"), ("low", "big"), ("out", "big")}
    assert points_in_regions(p, r.limit(0)).count() == 0
