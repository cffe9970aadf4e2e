"""The row-wise operators on streams: gating by fixed bounds, and transfer against fixed reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.operators.qc import gate


def gate_stream(cells: DataFrame, blanks: int, size_lim: tuple[float, float], blank_upper: Sequence[float], blank_lower: Sequence[float]) -> DataFrame:
    """gate() with given bounds, on a stream or a table; nothing is kept between batches."""
    return gate(cells, blanks, size_lim, blank_upper, blank_lower)


def transfer_stream(edges: DataFrame, shares: DataFrame) -> DataFrame:
    """Weighted shares (codex_id, feature, part) of a stream of transfer edges (codex_id, cite_id, weight) against a table (cell_id, feature, share); sum them downstream."""
    s = shares.select(F.col("cell_id").alias("cite_id"), "feature", "share")
    return edges.join(s, "cite_id").select("codex_id", "feature", (F.col("weight") * F.col("share")).alias("part"))


def arrivals(stream: DataFrame, ts: str, key: str, *, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window, key, rows) of a stream by event time; rows later than `late` behind the newest are not waited for."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", window).alias("window"), key).agg(F.count(F.lit(1)).alias("rows"))
