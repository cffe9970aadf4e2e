"""Points near other points and points inside regions, over a hash grid.

Both joins turn geometry into an equi-join on grid cells, so no pair of rows is ever formed that does not share or
touch a cell. Occupied cells are paired first (one row per cell, not per point); points are read only for cells
that have company. A crowded cell is dealt into parts of about `block` points before its points are joined with
anything, and each pair of parts is a task's key of its own, so that no task owns the cell.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.session import small, spread, stored

EARTH_RADIUS_M = 6_371_008.8


def _finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n)
    return ok


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres of two positions in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def on_sphere(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Adds x, y, z in metres on the sphere. Near pairs by great circle are near pairs by chord, so the grid needs no case for poles or the date line."""
    a, o = F.radians(F.col(lat)), F.radians(F.col(lon))
    r = F.lit(EARTH_RADIUS_M)
    return points.withColumns({"x": r * F.cos(a) * F.cos(o), "y": r * F.cos(a) * F.sin(o), "z": r * F.sin(a)})


def chord_m(distance_m: float) -> float:
    """The chord that belongs to a great-circle distance."""
    import math

    return 2 * EARTH_RADIUS_M * math.sin(distance_m / (2 * EARTH_RADIUS_M))


def near_pairs(points: DataFrame, radius: float, *, id_col: str = "id", group_col: str = "grp", axes: tuple[str, ...] = ("x", "y", "z"), block: int = 2048) -> DataFrame:
    """Pairs (grp, left_id, right_id), left_id < right_id, of ids of one group with positions at most `radius` apart.

    An id may have several positions; one close pair suffices. Rows with a null id, group or coordinate, or a NaN,
    take no part; repeated rows count once; an empty table gives an empty result. Columns other than those named
    are ignored, whatever their names.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    n = len(axes)
    cell = [F.floor(F.col(a) / F.lit(float(radius))) for a in axes]
    key = lambda g, cs: F.xxhash64(g, *cs)  # noqa: E731  (a clash of hashes only adds candidates: every pair is verified)
    pts = (
        points.where(_finite(*axes) & F.col(id_col).isNotNull() & F.col(group_col).isNotNull())
        .select(F.col(group_col).alias("_g"), F.col(id_col).alias("_id"), *[F.col(a).cast("double").alias(f"_a{i}") for i, a in enumerate(axes)], *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
        .distinct()
        .withColumn("_key", key(F.col("_g"), [F.col(f"_c{i}") for i in range(n)]))
    )
    cells = stored(pts.groupBy("_key", "_g", *[f"_c{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("_n")), "cells")
    # crowded cells, at most one for `block` rows: their points are dealt over parts before any join
    hot = small(stored(cells.groupBy("_key").agg(F.sum("_n").alias("_n")).where(F.col("_n") > block).select("_key", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_parts")), "hot"), 1_000_000)
    parts = F.coalesce("_parts", F.lit(1))
    ahead = [o for o in product((-1, 0, 1), repeat=n) if o > (0,) * n]
    to = F.array(*[key(F.col("_g"), [F.col(f"_c{i}") + F.lit(o) for i, o in enumerate(off)]) for off in ahead])
    there = cells.groupBy("_key").agg(F.sum("_n").alias("_m"))
    apart = cells.select(F.col("_key").alias("_from"), F.explode(to).alias("_to")).join(there.select(F.col("_key").alias("_to")), "_to").select("_from", "_to")
    alone = there.where("_m > 1").select(F.col("_key").alias("_from"), F.col("_key").alias("_to"))
    links = apart.unionByName(alone).distinct()
    # a link joins every part of one cell with every part of the other: one row for each pair of parts
    for x, p in (("_from", "_pf"), ("_to", "_pt")):
        links = links.join(hot.select(F.col("_key").alias(x), F.col("_parts").alias(p)), x, "left").withColumn(p, F.coalesce(p, F.lit(1)))
    links = links.withColumn("_bf", F.explode(F.sequence(F.lit(0), F.col("_pf") - 1))).withColumn("_bt", F.explode(F.sequence(F.lit(0), F.col("_pt") - 1))).drop("_pf", "_pt")
    cols = ["_g", "_id", *[f"_a{i}" for i in range(n)]]
    dealt = pts.join(hot, "_key", "left").withColumn("_b", F.pmod(F.xxhash64("_id", *[f"_a{i}" for i in range(n)]), parts).cast("int"))
    left = dealt.join(links, (F.col("_key") == F.col("_from")) & (F.col("_b") == F.col("_bf"))).select("_from", "_to", "_bf", "_bt", *[F.col(c).alias(f"l{c}") for c in cols])
    right = dealt.join(links, (F.col("_key") == F.col("_to")) & (F.col("_b") == F.col("_bt"))).select("_from", "_to", "_bf", "_bt", *[F.col(c).alias(f"r{c}") for c in cols])
    d2 = sum(((F.col(f"l_a{i}") - F.col(f"r_a{i}")) ** 2 for i in range(n)), F.lit(0.0))
    return (
        left.join(right, ["_from", "_to", "_bf", "_bt"])
        .where((F.col("l_g") == F.col("r_g")) & (F.col("l_id") != F.col("r_id")) & (d2 <= F.lit(float(radius) ** 2)))
        .select(F.col("l_g").alias("grp"), F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id"))
        .distinct()
    )


def inside_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd test of a point against the outline with corners xs, ys (either sense, closed or not, concave or not)."""
    n = F.size(xs)
    edges = F.zip_with(
        F.arrays_zip(xs.alias("x"), ys.alias("y")),
        F.arrays_zip(F.concat(F.slice(xs, 2, n), F.slice(xs, 1, 1)).alias("x"), F.concat(F.slice(ys, 2, n), F.slice(ys, 1, 1)).alias("y")),
        lambda a, b: (((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])).cast("int"),
    )
    return F.aggregate(edges, F.lit(0), lambda s, e: s + F.coalesce(e, F.lit(0))) % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, *, id_col: str = "id", group_col: str = "grp", x: str = "x", y: str = "y", region_id: str = "area_id", region_group: str = "slide_id", xs: str = "poly_x", ys: str = "poly_y") -> DataFrame:
    """Pairs (grp, left_id, right_id) of point ids and the regions of the same group whose outline holds the point.

    A region is kept at the grid level whose cells are as wide as its bounding box: it covers at most four of
    them however large it is, and a point looks up one cell for each level in use. Regions with fewer than three
    corners, a null or NaN corner, or unequal coordinate lists hold nothing. Null and NaN points take no part.
    """
    r = (
        regions.select(F.col(region_group).alias("_g"), F.col(region_id).alias("_rid"), F.col(xs).alias("_xs"), F.col(ys).alias("_ys"))
        .where(F.col("_g").isNotNull() & F.col("_rid").isNotNull() & (F.size("_xs") >= 3) & (F.size("_xs") == F.size("_ys")))
        .where(F.forall("_xs", lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall("_ys", lambda v: v.isNotNull() & ~F.isnan(v)))
        .withColumns({"_x0": F.array_min("_xs"), "_x1": F.array_max("_xs"), "_y0": F.array_min("_ys"), "_y1": F.array_max("_ys")})
        .withColumn("_level", F.ceil(F.log2(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9)))).cast("int"))
    )
    at = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level))
    cover = (
        r.withColumn("_cx", F.explode(F.sequence(at(F.col("_x0"), F.col("_level")), at(F.col("_x1"), F.col("_level")))))
        .withColumn("_cy", F.explode(F.sequence(at(F.col("_y0"), F.col("_level")), at(F.col("_y1"), F.col("_level")))))
    )
    levels = r.agg(F.collect_set("_level").alias("_levels"))  # a set of exponents of doubles: one short row at any size
    p = (
        points.where(_finite(x, y) & F.col(id_col).isNotNull() & F.col(group_col).isNotNull())
        .select(F.col(group_col).alias("_g"), F.col(id_col).alias("_id"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
        .join(F.broadcast(levels))
        .withColumn("_level", F.explode("_levels"))
        .withColumns({"_cx": at(F.col("_px"), F.col("_level")), "_cy": at(F.col("_py"), F.col("_level"))})
    )
    on = ["_g", "_level", "_cx", "_cy"]
    # an area as wide as a slide takes the slide's points in four cells: few outlines go to all tasks, many meet dealt points
    corners = cover.agg(F.coalesce(F.sum(F.size("_xs")), F.lit(0))).first()[0]
    p, cover, salt = spread(p, cover, limit=50_000 if corners <= 2_000_000 else 0)
    hit = p.join(cover, [*on, *salt]).where(F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1")))
    return hit.where(inside_polygon(F.col("_px"), F.col("_py"), F.col("_xs"), F.col("_ys"))).select(F.col("_g").alias("grp"), F.col("_id").alias("left_id"), F.col("_rid").alias("right_id")).distinct()


def near_pairs_on_earth(points: DataFrame, radius_m: float, *, id_col: str = "id", group_col: str = "grp", lat: str = "lat", lon: str = "lon", block: int = 2048) -> DataFrame:
    """near_pairs() for positions in degrees: candidates by chord in a three-dimensional grid, which differs from the great circle by less than rounding at the limit.

    Latitudes beyond 90 degrees and nulls or NaNs take no part; longitudes may be given in any turn.
    """
    ok = points.where(_finite(lat, lon) & F.col(lat).between(-90, 90)).select(F.col(id_col).alias("_pid"), F.col(group_col).alias("_pg"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    return near_pairs(on_sphere(ok, "_lat", "_lon"), chord_m(radius_m), id_col="_pid", group_col="_pg", block=block)
