"""Helpers every operator shares: sessions, table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side is sent to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 50_000


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each Spark context, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_cellweft_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="cellweft-"), "cellweft.zip")  # read on the driver only, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    sc._cellweft_shipped = True
    return spark


def local_session(app: str = "cellweft", cores: str | int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CELLWEFT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, else (a local master only) a temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cellweft-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cellweft-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables that this application wrote; results that are not read yet need them."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: columns can be pruned and sizes are known."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a step of a loop. A table, not a checkpoint: a checkpoint keeps the estimated size of its plan, which joins of joins blow up from round to round."""
    return stored(df, "step")


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Marks df for broadcast only after counting that it has at most `limit` rows; otherwise leaves the choice of join to the planner."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(big: DataFrame, few: DataFrame, limit: int | None = None, salts: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on keys of which one may hold most rows of `big`, and the columns to add to the keys.

    `few` is marked for broadcast when it is counted small. Otherwise the rows of `big` are dealt over `salts` and
    those of `few` repeated for each, so that no key's rows meet in one task.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    if few.limit(limit + 1).count() <= limit:
        return big, F.broadcast(few), []
    deal = F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.lit(salts)).cast("int")
    return big.withColumn("_salt", deal), few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_salt"]


def usable_vector(name: str, width: int):
    """True where the array has exactly `width` elements, none of them null or NaN, and not all of them equal."""
    v = F.col(name)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(v) == width) & whole & (F.array_max(v) > F.array_min(v)), F.lit(False))


def parse_cluster(name: str):
    """The cluster number in a label, whatever its spelling (`4`, `004`, `4.0`, `c4`, `C04`, `cluster_4`, `-1`), else null."""
    digits = F.regexp_extract(F.col(name), r"(?i)^\s*(?:cluster[_\s]?|c[_\s]?)?([-−]?\d{1,18})(?:\.0*)?\s*$", 1)
    return F.when(digits != "", F.translate(digits, "−", "-").cast("bigint"))
