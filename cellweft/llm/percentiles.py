"""Exact percentiles per group by bisection over value intervals, and daily summaries that can be combined.

Each pass keeps, for every group and percentile, the interval of values that still holds the wanted rank, cuts it at
`sections - 1` midpoints, counts the rows below each in one map-side combined aggregation, and keeps one section,
shrunk to the least and greatest value found in it. What is shuffled in a pass is at most groups x sections rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.session import cut, spread


def bisect_percentiles(df: DataFrame, groups: Sequence[str], value: str, ps: Sequence[float], *, sections: int = 64, finish: int = 1000, max_error: float = 0.0, max_passes: int = 400) -> DataFrame:
    """(groups, p, value, low, high, rank, n): for each group the smallest value whose rank reaches p * n.

    Null and NaN values are left out; rows with a null group column form a group of their own; a group without
    values gives no row; ties and repeated rows all count. A negative zero counts as zero. An interval is resolved
    when it holds one value, when it holds at most `finish` rows (a window over these alone picks the rank), or,
    with max_error > 0, when it is no wider than that: then value is its upper end, and low <= exact <= high.
    Infinite values are ordered at the ends and resolve as soon as an interval holds nothing else.
    """
    for p in ps:
        if not 0 <= p <= 1:
            raise ValueError("percentiles lie between 0 and 1")
    if sections < 2 or finish < 1:
        raise ValueError("sections must be at least 2 and finish at least 1")
    gs = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(a) for g, a in zip(groups, gs)], (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = lambda a, b: [F.expr(f"{a}.{g} <=> {b}.{g}") for g in gs]

    def within(state: DataFrame) -> DataFrame:
        """The rows in the intervals of a state; a group of any size is dealt over tasks."""
        big, spans, salt = spread(rows, state.select(*gs, "_lo", "_hi").distinct())
        return big.alias("r").join(spans.alias("s"), [*same("r", "s"), *[F.col(f"r.{c}") == F.col(f"s.{c}") for c in salt], F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")])

    first = rows.groupBy(*gs).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = cut(
        first.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
        .select(*gs, "_p", "_n", F.greatest(F.lit(1), F.ceil(F.round(F.col("_p") * F.col("_n"), 9))).cast("bigint").alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_c"))
    )
    wide = (F.col("_hi") > F.col("_lo")) & (F.col("_c") > finish) & ~(F.col("_hi") - F.col("_lo") <= F.lit(float(max_error)))
    for _ in range(max_passes):
        open_ = state.where(wide)
        if not open_.limit(1).count():
            break
        width = F.col("_hi") - F.col("_lo")
        # halves first, so that the width of an interval between finite ends never overflows
        part = F.least(F.lit(sections - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * F.lit(sections))).cast("int")
        edge = F.when(F.col("_v") == F.col("_lo"), F.lit(0)).when(F.col("_v") == F.col("_hi"), F.lit(sections - 1)).otherwise(F.when(F.isnan(width) | (width == float("inf")), F.when(F.abs(F.col("_v")) == float("inf"), F.lit(0)).otherwise(F.lit(sections // 2))).otherwise(part)).cast("int")
        counted = (
            within(open_).select(*[f"s.{g}" for g in gs], "_lo", "_hi", edge.alias("_part"), "_v")
            .groupBy(*gs, "_lo", "_hi", "_part").agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        )
        below = F.sum("_k").over(Window.partitionBy(*gs, "_lo", "_hi").orderBy("_part"))
        counted = counted.withColumn("_upto", below)
        kept = (
            open_.alias("s").join(counted.alias("c"), [*same("s", "c"), F.col("s._lo") == F.col("c._lo"), F.col("s._hi") == F.col("c._hi")])
            .where((F.col("_below") + F.col("_upto") >= F.col("_rank")) & (F.col("_below") + F.col("_upto") - F.col("_k") < F.col("_rank")))
            .select(*[f"s.{g}" for g in gs], "_p", "_n", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_k")).alias("_below"), F.col("_k").alias("_c"))
        )
        state = cut(state.where(~wide).unionByName(kept))
    else:
        raise RuntimeError("intervals did not narrow; raise max_passes or finish")
    left = state.where((F.col("_hi") > F.col("_lo")) & (F.col("_c") <= finish) & ~(F.col("_hi") - F.col("_lo") <= F.lit(float(max_error))))
    few = within(left).select(*[f"s.{g}" for g in gs], "_lo", "_hi", "_v")
    few = few.withColumn("_at", F.row_number().over(Window.partitionBy(*gs, "_lo", "_hi").orderBy("_v")))  # at most `finish` rows each
    picked = (
        left.alias("s").join(few.alias("c"), [*same("s", "c"), F.col("s._lo") == F.col("c._lo"), F.col("s._hi") == F.col("c._hi"), F.col("_below") + F.col("_at") == F.col("_rank")])
        .select(*[f"s.{g}" for g in gs], "_p", "_n", "_rank", F.col("_v").alias("_lo"), F.col("_v").alias("_hi"))
    )
    done = state.where((F.col("_hi") == F.col("_lo")) | (F.col("_hi") - F.col("_lo") <= F.lit(float(max_error)))).select(*gs, "_p", "_n", "_rank", "_lo", "_hi").unionByName(picked)
    return done.select(*[F.col(a).alias(g) for g, a in zip(groups, gs)], F.col("_p").alias("p"), F.col("_hi").alias("value"), F.col("_lo").alias("low"), F.col("_hi").alias("high"), F.col("_rank").alias("rank"), F.col("_n").alias("n"))


def summarise(df: DataFrame, groups: Sequence[str], part: str, value: str, *, points: int = 50) -> DataFrame:
    """Per group and part (a day, a partition) `points` exact quantiles with the rows each stands for: (groups, part, value, weight).

    Summaries are small tables that can be kept; combine() merges any union of them.
    """
    got = bisect_percentiles(df, [*groups, part], value, [j / points for j in range(1, points + 1)])
    before = F.lag("rank", 1, 0).over(Window.partitionBy(*groups, part).orderBy("p"))  # `points` rows each
    return got.withColumn("weight", F.col("rank") - before).where("weight > 0").select(*groups, part, "value", "weight")


def combine(summaries: DataFrame, groups: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """(groups, p, value, n) from the union of summaries: the rank of each value is within n / points of the wanted one."""
    per = summaries.groupBy(*groups, "value").agg(F.sum("weight").alias("_w"))
    by = Window.partitionBy(*groups)  # parts x points rows each, whatever the size of the data
    run = per.withColumns({"_upto": F.sum("_w").over(by.orderBy("value")), "_n": F.sum("_w").over(by)})
    run = run.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    want = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("_n"), 9)))
    return run.where(F.col("_upto") >= want).groupBy(*groups, "p").agg(F.min("value").alias("value"), F.first("_n").alias("n"))
