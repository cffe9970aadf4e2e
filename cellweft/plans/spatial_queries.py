"""Queries on positions: cells near cells and cells inside tissue areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators.spatial import near_pairs, points_in_regions
from cellweft.session import table

#: Nm per voxel in x and y, in z; the limit of nearness in nm.
VOXEL_XY, VOXEL_Z, NEAR_NM = 188.0, 900.0, 1500.0


def positions_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell positions in nm with slide, of the rows that have a slide and all three coordinates."""
    scale = lambda c, k: F.col(c) * F.when(F.col("coord_unit") == "voxel", F.lit(k)).otherwise(F.lit(1.0))
    ok = F.col("slide_id").isNotNull()
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return table(spark, sf_dir, "codex_spatial").where(ok).select("slide_id", "cell_id", scale("x", VOXEL_XY).alias("x"), scale("y", VOXEL_XY).alias("y"), scale("z", VOXEL_Z).alias("z"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = positions_nm(spark, sf_dir)
    near = near_pairs(pos, NEAR_NM, id_col="cell_id", group_col="slide_id").select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = points_in_regions(pos, table(spark, sf_dir, "tissue_areas"), id_col="cell_id", group_col="slide_id").select(F.lit("inside").alias("kind"), "left_id", "right_id")
    return near.unionByName(inside).distinct()


def p1_area_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every tissue area the cells inside it and how many of them have a neighbour within the limit."""
    pos = positions_nm(spark, sf_dir)
    near = near_pairs(pos, NEAR_NM, id_col="cell_id", group_col="slide_id")
    company = near.select(F.explode(F.array("left_id", "right_id")).alias("cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("neighbours"))
    inside = points_in_regions(pos, table(spark, sf_dir, "tissue_areas"), id_col="cell_id", group_col="slide_id").select("left_id", "right_id").distinct()
    return (
        inside.join(company, inside.left_id == company.cell_id, "left").groupBy(F.col("right_id").alias("area_id"))
        .agg(F.count(F.lit(1)).alias("cells"), F.count("neighbours").alias("cells_with_neighbour"), F.coalesce(F.sum("neighbours"), F.lit(0)).alias("neighbour_links"))
    )


_POS = """pos AS (
  SELECT DISTINCT slide_id, cell_id, x * CASE WHEN coord_unit = 'voxel' THEN 188.0 ELSE 1.0 END AS x,
         y * CASE WHEN coord_unit = 'voxel' THEN 188.0 ELSE 1.0 END AS y, z * CASE WHEN coord_unit = 'voxel' THEN 900.0 ELSE 1.0 END AS z
  FROM codex_spatial
  WHERE slide_id IS NOT NULL AND cell_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
near AS (
  SELECT DISTINCT a.slide_id, least(a.cell_id, b.cell_id) AS left_id, greatest(a.cell_id, b.cell_id) AS right_id
  FROM pos a JOIN pos b ON a.slide_id = b.slide_id AND a.cell_id < b.cell_id
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1500.0 * 1500.0),
corner AS (
  SELECT area_id, slide_id, unnest(range(1, len(poly_x) + 1)) AS i, len(poly_x) AS n, poly_x, poly_y FROM tissue_areas),
edge AS (
  SELECT area_id, slide_id, poly_x[i] AS x1, poly_y[i] AS y1, poly_x[i % n + 1] AS x2, poly_y[i % n + 1] AS y2 FROM corner),
crossing AS (
  SELECT p.cell_id, e.area_id, p.x, p.y, p.z, count(*) AS k
  FROM pos p JOIN edge e ON p.slide_id = e.slide_id AND (e.y1 > p.y) <> (e.y2 > p.y)
  WHERE p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL),
inside AS (SELECT DISTINCT cell_id AS left_id, area_id AS right_id FROM crossing WHERE k % 2 = 1)"""

SQL = {
    "p1_found": f"""WITH {_POS}
SELECT DISTINCT * FROM (SELECT 'near' AS kind, left_id, right_id FROM near UNION ALL SELECT 'inside', left_id, right_id FROM inside)""",
    "p1_area_census": f"""WITH {_POS},
company AS (SELECT cell_id, count(*) AS neighbours FROM (SELECT left_id AS cell_id FROM near UNION ALL SELECT right_id FROM near) GROUP BY 1)
SELECT right_id AS area_id, count(*) AS cells, count(neighbours) AS cells_with_neighbour, CAST(coalesce(sum(neighbours), 0) AS BIGINT) AS neighbour_links
FROM inside LEFT JOIN company ON left_id = cell_id GROUP BY 1""",
}
QUERIES = {"p1_found": p1_found, "p1_area_census": p1_area_census}
