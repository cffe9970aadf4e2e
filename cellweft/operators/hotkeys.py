"""Results per key when a few keys hold most records.

Rows are first counted by (key, value), which spreads a hot key over as many tasks as it has values and shrinks its
repeats to one weighted row. Counts, distinct counts, modes and exact percentiles are then derived from the weights.
No step sorts or gathers one key's values in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.session import cut, small, spread


def compress(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """(keys, value, weight): how often each value occurs for each key; null values keep a row of their own."""
    v = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, v.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("weight"))


def profile(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: rows, non-null rows, distinct non-null values, the mode (ties: the smallest value) and its weight.

    Takes compress()'s rows. Every aggregate combines on the map side, so a key's rows never meet in one task.
    A key with only null values has 0 distinct values and a null mode.
    """
    held = F.col("value").isNotNull()
    most = weighted.where(held).groupBy(*keys).agg(F.max("weight").alias("_top"))
    big, most, salt = spread(weighted.where(held), most)
    mode = (
        big.join(most, [*keys, *salt]).where("weight = _top").groupBy(*keys)
        .agg(F.min("value").alias("mode"), F.first("weight").alias("mode_rows"))
    )
    total = weighted.groupBy(*keys).agg(F.sum("weight").alias("rows"), F.coalesce(F.sum(F.when(held, F.col("weight"))), F.lit(0)).alias("value_rows"), F.count(F.when(held, 1)).alias("distinct_values"))
    return total.join(mode, list(keys), "left")


def weighted_percentiles(weighted: DataFrame, keys: Sequence[str], ps: Sequence[float], *, splitters: int = 256, block: int = 50_000, rounds: int = 12) -> DataFrame:
    """Exact discrete percentiles (key, p, value, rank, n): the smallest value whose rank reaches p of the weight.

    Takes compress()'s rows with a numeric value; null and NaN values carry no weight. For each key and p an interval
    (lo, hi] that holds the answer is split at up to `splitters` sampled values; one pass sums the weights between
    them and keeps the part where the rank falls. As soon as every interval has at most `block` distinct values, a
    window over those alone finishes. Keys without weight give no row.
    """
    for p in ps:
        if not 0 <= p <= 1:
            raise ValueError("percentiles lie between 0 and 1")
    asked = F.array(*[F.struct(F.lit(float(p)).alias("_p"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(p)) * F.col("_n"), 9))).cast("bigint").alias("_rank")) for p in ps])
    return _at_ranks(weighted, keys, asked, splitters, block, rounds)


def quantiles_interpolated(weighted: DataFrame, keys: Sequence[str], ps: Sequence[float], *, block: int = 50_000) -> DataFrame:
    """(key, p, value): quantiles interpolated linearly between the two order statistics around p * (n - 1)."""
    at = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    sides = [F.struct(F.lit(float(p)).alias("_p"), (side(at(p)) + 1).cast("bigint").alias("_rank")) for p in ps for side in (F.floor, F.ceil)]
    got = _at_ranks(weighted, keys, F.array_distinct(F.array(*sides)), 256, block, 12)
    part = F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))
    both = got.groupBy(*keys, "p").agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.first("n").alias("n"))
    return both.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("value"))


def _at_ranks(weighted: DataFrame, keys: Sequence[str], asked: Column, splitters: int, block: int, rounds: int) -> DataFrame:
    """The values at the ranks that `asked`, an array of (_p, _rank) over a key's weight _n, names; see weighted_percentiles()."""
    ks = list(keys)
    w = weighted.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(*ks, F.col("value").cast("double").alias("_v"), F.col("weight").cast("bigint").alias("_w"))
    base = w.groupBy(*ks).agg(F.sum("_w").alias("_n"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_k"))
    state = base.select(*ks, "_n", "_hi", "_k", F.inline(asked)).select(*ks, "_p", "_n", "_rank", F.lit(float("-inf")).alias("_lo"), "_hi", F.lit(0).cast("bigint").alias("_below"), "_k")
    by = [*ks, "_p", "_rank"]
    for _ in range(rounds):
        state = cut(state)
        if not state.where(F.col("_k") > block).limit(1).count():
            break
        wide = state.where(F.col("_k") > block)
        big, few, salt = spread(w, wide)
        inside = big.join(few, [*ks, *salt]).drop(*salt).where((F.col("_v") > F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        marks = inside.groupBy(*by).agg(F.array_sort(F.array_distinct(F.expr(f"approx_percentile(_v, array({', '.join(str(i / splitters) for i in range(1, splitters))}), 10000)"))).alias("_marks"))
        part = F.size(F.filter("_marks", lambda m: m < F.col("_v")))
        big, few, salt = spread(inside, marks)
        sums = big.join(few, [*by, *salt]).withColumn("_part", part).groupBy(*by, "_part").agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_top"), F.min("_v").alias("_bot"))
        order = Window.partitionBy(*by).orderBy("_part")  # at most `splitters` rows each
        run = (
            sums.join(wide.select(*by, "_n", "_below", F.col("_lo").alias("_lo0")), by)
            .withColumn("_upto", F.col("_below") + F.sum("_s").over(order))
            .withColumn("_prev", F.lag("_top").over(order))
            .where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_s") < F.col("_rank")))
            .select(*ks, "_p", "_n", "_rank", F.coalesce("_prev", "_lo0").alias("_lo"), F.col("_top").alias("_hi"), (F.col("_upto") - F.col("_s")).alias("_below"), F.col("_c").alias("_k"))
        )
        state = state.where(F.col("_k") <= block).unionByName(run)
    big, few, salt = spread(w, state)
    last = big.join(few, [*ks, *salt]).where((F.col("_v") > F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    upto = F.col("_below") + F.sum("_w").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return (
        last.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_w") < F.col("_rank")))
        .select(*ks, F.col("_p").alias("p"), F.col("_v").alias("value"), F.col("_rank").alias("rank"), F.col("_n").alias("n"))
    )


def heavy_keys(weighted: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that at least `share` of all rows with a key carry (key, rows, total). Takes compress()'s rows; null keys carry none."""
    per = weighted.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("weight").alias("rows"))
    total = per.agg(F.sum("rows").alias("total"))
    return per.join(F.broadcast(total)).where(F.col("rows") >= F.lit(share) * F.col("total"))  # total is one row


def keyed_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the row count and the mean of each numeric column, nulls and NaNs left out; sums combine on the map side."""
    good = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(good(c)).alias(c) for c in values])


def salted_join(big: DataFrame, other: DataFrame, key: str, *, how: str = "inner", hot_rows: int = 1_000_000, salts: int = 32) -> DataFrame:
    """Equi-join on `key` that spreads keys with over `hot_rows` rows in `big` over `salts` tasks.

    Only the hot keys' rows of `other` are repeated. `how` is inner or left. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = small(big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows).select(key, F.lit(True).alias("_hot")))
    names = [c for c in big.columns if c != key]
    spread = F.pmod(F.xxhash64(key, *[F.col(c) for c in names]), F.lit(salts)).cast("int") if names else F.lit(0)
    left = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    right = other.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
