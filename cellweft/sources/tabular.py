"""Delimited and Parquet tables in, Parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.frames import transpose
from cellweft.operators.qc import first_wins, strip_prefix


def read_delimited(spark: SparkSession, path: str, *, header: bool = True, sep: str = ",", id_name: str = "cell_id", columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A delimited file whose first column holds the row names. A schema spares the pass that infers it."""
    r = spark.read.options(header=header, sep=sep)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if columns:
        df = df.toDF(*columns)
    return df.withColumnRenamed(df.columns[0], id_name)


def read_feature_rows(spark: SparkSession, path: str, *, sep: str = ",", prefix: str | None = None) -> DataFrame:
    """(cell_id, feature, value) from a file with a row per feature and a column per cell."""
    df = read_delimited(spark, path, sep=sep, id_name="feature")
    long = transpose(df, "feature", df.columns[1:])
    return strip_prefix(long, "feature", prefix) if prefix else long


def name_genes(long: DataFrame, gene_map: DataFrame) -> DataFrame:
    """Identifiers replaced by symbols (id, symbol, position): the first of a repeated symbol wins, unknown ones go."""
    one = first_wins(first_wins(gene_map, "id", "position"), "symbol", "position").select(F.col("id").alias("feature"), "symbol")
    return long.join(one, "feature").select("cell_id", F.col("symbol").alias("feature"), "value")


def first_latent(df: DataFrame, n: int) -> DataFrame:
    """The first n latent dimensions, or all if there are fewer."""
    return df.select("cell_id", F.slice("vec", 1, n).alias("vec"))


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)
