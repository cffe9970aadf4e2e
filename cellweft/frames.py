"""Matrices as tables: dense (cell, vector) and long (cell, feature, value), and the container of an analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(cell_id, vec) from one column per feature."""
    return df.select(F.col(id_col).alias("cell_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("vec"))


def to_long(df: DataFrame, features: Sequence[str] | None = None, *, zeros: bool = True) -> DataFrame:
    """(cell_id, feature, value) from (cell_id, vec); features are names, or positions from 1 up."""
    out = df.select("cell_id", F.posexplode("vec").alias("i", "value"))
    if features is None:
        out = out.select("cell_id", (F.col("i") + 1).alias("feature"), F.col("value").cast("double"))
    else:
        names = F.array(*[F.lit(f) for f in features])
        out = out.select("cell_id", F.element_at(names, F.col("i") + 1).alias("feature"), F.col("value").cast("double"))
    return out if zeros else out.where("value <> 0")


def to_dense(long: DataFrame, features: Sequence) -> DataFrame:
    """(cell_id, vec) with the features in the order given; what is missing is 0. Sums per cell and feature combine on the map side."""
    parts = [F.coalesce(F.sum(F.when(F.col("feature") == F.lit(f), F.col("value"))), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    wide = long.groupBy("cell_id").agg(*parts)
    return wide.select("cell_id", F.array(*[f"f{i}" for i in range(len(features))]).alias("vec"))


def transpose(df: DataFrame, name_col: str, cells: Sequence[str]) -> DataFrame:
    """(cell_id, feature, value) from a table with a row per feature and a column per cell."""
    return df.select(F.col(name_col).alias("feature"), F.expr("stack({}, {}) AS (cell_id, value)".format(len(cells), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cells)))).select("cell_id", "feature", "value")


def with_ids(df: DataFrame, order_by: Sequence[str], name: str = "cell_id") -> DataFrame:
    """Row names "1", "2", … in the order of the given columns, without sorting in one task: partition offsets are added to local numbers."""
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    from cellweft.session import stored

    kept = stored(ranged, "ids")
    sizes = kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))  # a row for each partition
    before = sizes.select("_pid", "_first", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_before"))
    return kept.join(F.broadcast(before), "_pid").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("string")).drop("_pid", "_at", "_first", "_before")


@dataclass(frozen=True)
class CellData:
    """The tables of an analysis, all lazy. cite_* is the reference side, codex_* the imaging side; None is not computed.

    dense tables: (cell_id, vec); long: (cell_id, feature, value); clusters: (cell_id, cluster); embeddings: (cell_id, e1, e2);
    k-NN: (q, d, rank, dist); transfer: (codex_id, cite_id, weight).
    """

    cite_mrna: DataFrame | None = None
    cite_mrna_norm: DataFrame | None = None
    cite_latent: DataFrame | None = None
    cite_emb: DataFrame | None = None
    cite_clusters: DataFrame | None = None
    cite_protein: DataFrame | None = None
    cite_clean: DataFrame | None = None
    cite_features: tuple[str, ...] = ()
    codex_protein: DataFrame | None = None
    codex_features: tuple[str, ...] = ()
    codex_size: DataFrame | None = None
    codex_blanks: DataFrame | None = None
    codex_spatial: DataFrame | None = None
    codex_emb: DataFrame | None = None
    codex_knn: DataFrame | None = None
    codex_clusters: DataFrame | None = None
    codex_clean: DataFrame | None = None
    corrected_codex: DataFrame | None = None
    corrected_features: tuple[str, ...] = ()
    transfer_matrix: DataFrame | None = None
    codex_mrna: DataFrame | None = None
    scan: dict = field(default_factory=dict)

    def but(self, **changes) -> CellData:
        return replace(self, **changes)

    def need(self, *names: str) -> None:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"not available yet: {', '.join(missing)}")
