"""Quality control: gates on size and blank channels, filters on counts, choice of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.operators.hotkeys import compress, quantiles_interpolated

#: Quantiles of the default gate.
SIZE_LOW, SIZE_HIGH, BLANK_LOW, BLANK_HIGH = 0.025, 0.99, 0.002, 0.995


def gate_bounds(cells: DataFrame, blanks: int, size_lim: tuple[float, float] | None = None, blank_upper: Sequence[float] | None = None, blank_lower: Sequence[float] | None = None) -> DataFrame:
    """One row (size_lo, size_hi, lower, upper) for cells (size, blanks): given bounds, or exact interpolated quantiles."""
    ask = {}
    if size_lim is None:
        ask["size"] = (SIZE_LOW, SIZE_HIGH)
    if blank_upper is None or blank_lower is None:
        ask |= {f"b{i}": (BLANK_LOW, BLANK_HIGH) for i in range(blanks)}
    num = lambda x: F.lit(float(x))
    if not ask:
        one = cells.sparkSession.range(1)
        return one.select(num(size_lim[0]).alias("size_lo"), num(size_lim[1]).alias("size_hi"), F.array(*map(num, blank_lower)).alias("lower"), F.array(*map(num, blank_upper)).alias("upper"))
    values = [F.struct(F.lit(k).alias("field"), (F.col("size") if k == "size" else F.get("blanks", F.lit(int(k[1:])))).cast("double").alias("v")) for k in ask]
    every = cells.select(F.inline(F.array(*values)))
    q = quantiles_interpolated(compress(every, ["field"], "v"), ["field"], [SIZE_LOW, SIZE_HIGH, BLANK_LOW, BLANK_HIGH])
    at = lambda f, p: F.max(F.when((F.col("field") == f) & (F.col("p") == p), F.col("value")))
    lo = at("size", SIZE_LOW) if size_lim is None else num(size_lim[0])
    hi = at("size", SIZE_HIGH) if size_lim is None else num(size_lim[1])
    lower = [at(f"b{i}", BLANK_LOW) if blank_lower is None else num(blank_lower[i]) for i in range(blanks)]
    upper = [at(f"b{i}", BLANK_HIGH) if blank_upper is None else num(blank_upper[i]) for i in range(blanks)]
    return q.agg(lo.alias("size_lo"), hi.alias("size_hi"), F.array(*lower).alias("lower"), F.array(*upper).alias("upper"))


def gate(cells: DataFrame, blanks: int, size_lim: tuple[float, float] | None = None, blank_upper: Sequence[float] | None = None, blank_lower: Sequence[float] | None = None) -> DataFrame:
    """Cells whose size lies within bounds, with any blank at or above its lower bound and all at or below their upper.

    `cells` has (size, blanks array) besides whatever else; rows with a null or NaN size, or a blank that is missing,
    null or NaN, are dropped. Bounds are inclusive.
    """
    b = F.broadcast(gate_bounds(cells, blanks, size_lim, blank_upper, blank_lower).select(F.struct("*").alias("_bound")))  # one row
    whole = (F.size("blanks") >= blanks) & F.forall(F.slice("blanks", 1, blanks), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    some = F.exists(F.zip_with(F.slice("blanks", 1, blanks), F.col("_bound.lower"), lambda x, lo: x >= lo), lambda ok: ok)
    every = F.forall(F.zip_with(F.slice("blanks", 1, blanks), F.col("_bound.upper"), lambda x, hi: x <= hi), lambda ok: ok)
    size = F.col("size").cast("double")
    return cells.join(b).where(~F.isnan(size) & size.between(F.col("_bound.size_lo"), F.col("_bound.size_hi")) & whole & some & every).drop("_bound")


def filter_counts(long: DataFrame, min_transcripts: float = 1200, min_cells: int = 30) -> DataFrame:
    """(cell_id, feature, value) of cells with at least min_transcripts in all and of features not 0 in at least min_cells of these."""
    cells = long.groupBy("cell_id").agg(F.sum("value").alias("_t")).where(F.col("_t") >= min_transcripts).select("cell_id")
    kept = long.join(cells, "cell_id", "left_semi")
    genes = kept.where("value <> 0").groupBy("feature").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_cells).select("feature")
    return kept.join(genes, "feature", "left_semi").select("cell_id", "feature", "value")


def common_features(first: Sequence[str], second: Sequence[str]) -> list[str]:
    """Features of both, in the order of the first; fewer than two are an error."""
    have = set(second)
    out = [f for f in first if f in have]
    if len(out) < 2:
        raise ValueError("the two sides share fewer than two features")
    return out


def only_features(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose feature occurs in a list of pairs (f, g)."""
    named = pairs.select(F.col("f").alias("feature")).unionByName(pairs.select(F.col("g").alias("feature"))).distinct()
    return long.join(named, "feature", "left_semi")


def first_wins(df: DataFrame, name: str, position: str) -> DataFrame:
    """The first row of each name by position; ties by nothing, so positions should be unique."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(name).orderBy(position))).where("_rn = 1").drop("_rn")


def window(df: DataFrame, x_below: float, y_below: float) -> DataFrame:
    return df.where((F.col("x") < x_below) & (F.col("y") < y_below))


def drop_channels(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return df.where(~F.col(name).rlike(pattern))


def strip_prefix(df: DataFrame, name: str, prefix: str) -> DataFrame:
    return df.withColumn(name, F.regexp_replace(name, f"^{prefix}", ""))
