"""Flow-cytometry files as a data source: a header and keywords read once, events in slices of fixed-width records.

    spark.dataSource.register(FcsDataSource)
    spark.read.format("fcs").load(path)
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cellweft.frames import CellData, dense

#: Nm for a pixel in x and y, and for a step in z.
X_PIX, Y_PIX, Z_PIX = 188.0, 188.0, 900.0


def keywords(path: str) -> dict[str, str]:
    """The keyword section, with the byte range of the events under `begin` and `end`."""
    with open(path, "rb") as f:
        head = f.read(58)
        if head[:3] != b"FCS":
            raise ValueError(f"{path} is not an FCS file")
        first, last, begin, end = (int(head[i : i + 8].strip() or 0) for i in (10, 18, 26, 34))
        f.seek(first)
        text = f.read(last - first + 1).decode("latin-1")
    mark = text[0]
    parts = [p.replace("\x00", mark) for p in text[1:].rstrip(mark).replace(mark * 2, "\x00").split(mark)]
    out = {parts[i].strip().upper(): parts[i + 1] for i in range(0, len(parts) - 1, 2)}
    if not begin:
        begin, end = int(out["$BEGINDATA"]), int(out["$ENDDATA"])
    return out | {"begin": str(begin), "end": str(end)}


def channels(kw: dict[str, str]) -> list[tuple[str, str]]:
    """(short name, long name) of each parameter."""
    return [(kw[f"$P{i}N"], kw.get(f"$P{i}S", "")) for i in range(1, int(kw["$PAR"]) + 1)]


def unique_names(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def record_type(kw: dict[str, str]) -> np.dtype:
    order = "<" if kw.get("$BYTEORD", "1,2,3,4").startswith("1") else ">"
    kind = kw.get("$DATATYPE", "F").upper()
    if kind not in "FDI":
        raise ValueError(f"data type {kind} is not supported")
    fields = []
    for i in range(1, int(kw["$PAR"]) + 1):
        width = int(kw[f"$P{i}B"]) // 8
        fields.append((f"p{i}", order + {"F": "f4", "D": "f8"}.get(kind, f"u{width}")))
    return np.dtype(fields)


class _Slice(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_part: int):
        self.path, self.per_part = path, per_part
        self.kw = keywords(path)

    def partitions(self):
        n = int(self.kw["$TOT"])
        return [_Slice(i, min(n, i + self.per_part)) for i in range(0, n, self.per_part)] or [_Slice(0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        kind = record_type(self.kw)
        names = ["event", *unique_names([n for n, _ in channels(self.kw)])]
        with open(self.path, "rb") as f:
            at = part.start
            while at < part.stop:
                n = min(50_000, part.stop - at)
                f.seek(int(self.kw["begin"]) + at * kind.itemsize)
                rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                cols = [pa.array(np.arange(at + 1, at + len(rows) + 1)), *[pa.array(rows[c].astype(np.float64)) for c in kind.names]]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += n


class FcsDataSource(DataSource):
    """Columns: event (1 from the start of the file) and one double for each parameter, as stored. Option events_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def schema(self) -> StructType:
        names = unique_names([n for n, _ in channels(keywords(self.options["path"]))])
        return StructType([StructField("event", LongType())] + [StructField(n, DoubleType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("events_per_partition", 1_000_000)))


def read_fcs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FcsDataSource)
    return spark.read.format("fcs").load(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(idx, column, channel): the data columns and the long names of the parameters."""
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(channels(keywords(path)), 1)], "idx int, `column` string, channel string")


def canonical(name: str) -> str:
    """Lower case, and "X.X" to "X" where a doubled part is found first."""
    m = re.search(r"(.+)\.\1", name)
    return (m[1] if m else name).lower()


def tile_to_absolute(df: DataFrame, num_tile_x: int = 9) -> DataFrame:
    """Positions within tiles to positions on the slide, from tile_nr or tile_num (counted along x from 1) or x_tile and y_tile."""
    names = set(df.columns)
    far = F.broadcast(df.agg(F.max("x").alias("_mx"), F.max("y").alias("_my")))  # one row
    out = df.join(far)
    tile = next((t for t in ("tile_nr", "tile_num") if t in names), None)
    if tile:
        t = F.col(tile) - 1
        return out.withColumns({"x": F.floor(t / num_tile_x) * F.col("_mx") + F.col("x"), "y": F.pmod(t, F.lit(num_tile_x)) * F.col("_my") + F.col("y")}).drop("_mx", "_my")
    if {"x_tile", "y_tile"} <= names:
        return out.withColumns({"x": (F.col("x_tile") - 1) * F.col("_mx") + F.col("x"), "y": (F.col("y_tile") - 1) * F.col("_my") + F.col("y")}).drop("_mx", "_my")
    raise ValueError("tile positions need tile_nr, tile_num, or x_tile and y_tile")


def to_nm(df: DataFrame, x: float = X_PIX, y: float = Y_PIX, z: float = Z_PIX) -> DataFrame:
    return df.withColumns({"x": F.col("x") * x, "y": F.col("y") * y, "z": F.col("z") * z})


def codex_from_fcs(spark: SparkSession, path: str, is_protein: Sequence[bool], is_blank: Sequence[bool], protein_names: Sequence[str] | None = None, *, tile_relative: bool = False, num_tile_x: int = 9, pixels: tuple[float, float, float] = (X_PIX, Y_PIX, Z_PIX), warn=print) -> CellData:
    """The imaging tables of a file: proteins and blanks by mask, positions, sizes. What is missing is said through warn; blanks and sizes are then 0."""
    raw = read_fcs(spark, path)
    names = raw.columns[1:]
    cells = raw.withColumn("cell_id", F.col("event").cast("string"))
    blanks = [n for n, b in zip(names, is_blank) if b]
    if not blanks:
        warn("no blank channels: one channel of zeros is used")
    proteins = [n for n, b in zip(names, is_protein) if b]
    shown = [canonical(n) for n in proteins]
    if protein_names is not None:
        if len(protein_names) != len(proteins):
            raise ValueError("as many names are needed as protein channels")
        shown = [canonical(n) for n in protein_names]
    low = {canonical(n): n for n in reversed(names)}
    axes = cells.select("cell_id", *[F.col(f"`{n}`").alias(c) for c, n in low.items() if c in ("x", "y", "z", "size", "tile_nr", "tile_num", "x_tile", "y_tile")])
    spatial = None
    if {"x", "y", "z"} <= set(low):
        spatial = tile_to_absolute(axes, num_tile_x) if tile_relative else axes
        spatial = to_nm(spatial, *pixels).select("cell_id", "x", "y", "z")
    else:
        warn("no x, y and z channels: there are no positions")
    if "size" not in low:
        warn("no size channel: sizes are 0")
    quoted = lambda n: f"`{n}`"
    return CellData(
        codex_protein=dense(cells, "cell_id", [quoted(n) for n in proteins]), codex_features=tuple(shown),
        codex_blanks=cells.select("cell_id", F.array(*[F.col(quoted(n)) for n in blanks] or [F.lit(0.0)]).alias("blanks")),
        codex_size=axes.select("cell_id", (F.col("size") if "size" in low else F.lit(0.0)).alias("size")), codex_spatial=spatial,
    )


def write_fcs(path: str, names: Sequence[str], rows: np.ndarray, long_names: Sequence[str] | None = None) -> None:
    """A plain file of little-endian floats, for exports and tests."""
    data = np.asarray(rows, "<f4").tobytes()
    kw = {"$DATATYPE": "F", "$MODE": "L", "$BYTEORD": "1,2,3,4", "$PAR": len(names), "$TOT": len(rows), "$NEXTDATA": 0}
    for i, n in enumerate(names, 1):
        kw |= {f"$P{i}N": n, f"$P{i}S": (long_names or names)[i - 1], f"$P{i}B": 32, f"$P{i}R": 262144, f"$P{i}E": "0,0"}
    text = ("|" + "|".join(f"{k}|{str(v).replace('|', '||')}" for k, v in kw.items()) + "|").encode("latin-1")
    begin = 58 + len(text)
    head = b"FCS3.0    " + b"".join(f"{x:>8}".encode() for x in (58, begin - 1, begin, begin + len(data) - 1, 0, 0))
    with open(path, "wb") as f:
        f.write(head + text + data)
