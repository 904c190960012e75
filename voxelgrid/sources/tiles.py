"""Tiles as bytes: packing voxels, writing and reading tile files, and the small text tables.

A tile file has no header: records follow each other in raster order, x fastest. Names carry
the place. Files are written by the executors to any store that pyarrow can reach, under a
temporary name first.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, parse_info_name, parse_tile_name, tile_of
from ..functions.profiles import VoxelProfile


def with_tiles(voxels: DataFrame, meta: GridMeta) -> DataFrame:
    tx, ty, tz = tile_of(meta, F.col("x"), F.col("y"), F.col("z"))
    return voxels.withColumns({"tx": tx, "ty": ty, "tz": tz})


def pack(voxels: DataFrame, meta: GridMeta, profile: VoxelProfile) -> DataFrame:
    """(tx, ty, tz, content): one row per tile. A tile is the unit of storage and bounds a group."""
    dtype, names = profile.dtype, profile.attributes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"])
        out = np.empty(len(pdf), dtype)
        for n in names:
            out[n] = pdf[n]
        first = pdf.iloc[0]
        return pd.DataFrame({"tx": [first.tx], "ty": [first.ty], "tz": [first.tz], "content": [out.tobytes()]})

    rows = with_tiles(voxels, meta).select("tx", "ty", "tz", "x", "y", "z", *names)
    return rows.groupBy("tx", "ty", "tz").applyInPandas(run, "tx int, ty int, tz int, content binary")


def unpack(tiles: DataFrame, meta: GridMeta, profile: VoxelProfile) -> DataFrame:
    """Voxels of (tx, ty, tz, content) rows; a file of another length than its tile's is an error."""
    dtype, names = profile.dtype, profile.attributes

    def run(frames):
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                x0, y0, z0 = t.tx * meta.cx, t.ty * meta.cy, t.tz * meta.cz
                dx, dy, dz = min(meta.cx, meta.x - x0), min(meta.cy, meta.y - y0), min(meta.cz, meta.z - z0)
                if len(t.content) != dx * dy * dz * dtype.itemsize:
                    raise ValueError(f"tile {t.tx},{t.ty},{t.tz} has {len(t.content)} bytes")
                values = np.frombuffer(t.content, dtype)
                i = np.arange(len(values))
                cells = {"x": x0 + i % dx, "y": y0 + i // dx % dy, "z": z0 + i // (dx * dy)}
                kinds = {n: k[0].newbyteorder("=") for n, k in dtype.fields.items()}
                yield pd.DataFrame(cells | {n: values[n].astype(kinds[n]) for n in names})

    return tiles.select("tx", "ty", "tz", "content").mapInPandas(run, f"x int, y int, z int, {profile.ddl()}")


def info_name(meta: GridMeta, prefix: str) -> str:
    return f"{prefix}_info_{meta.nx}_{meta.ny}_{meta.nz}_{meta.cx}_{meta.cy}_{meta.cz}_{meta.raster}"


def tile_name(raster: str, prefix: str):
    """The file name of a tile; 2D names (prefix grid) have the row first and no z."""
    parts = ["ty", "tx"] if prefix == "grid" else ["tx", "ty", "tz"]
    return F.concat_ws("_", F.lit(prefix), F.lit(raster), *(F.col(c).cast("string") for c in parts))


def write_tiles(voxels: DataFrame, meta: GridMeta, profile: VoxelProfile, folder: str, prefix: str = "r3d") -> DataFrame:
    """Writes the marker and all tile files; returns (path, bytes) of the tiles."""
    if meta.x % meta.cx or meta.y % meta.cy or meta.z % meta.cz:
        raise ValueError("tiles must divide the raster")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{info_name(meta, prefix)}") as f:
        f.write((1).to_bytes(4, "big"))

    def run(frames):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                temporary = f"{base}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary) as f:
                    f.write(content)
                fs.move(temporary, f"{base}/{name}")
            yield pd.DataFrame({"path": base + "/" + pdf["name"], "bytes": pdf["content"].str.len()})

    packed = pack(voxels, meta, profile).select(tile_name(meta.raster, prefix).alias("name"), "content")
    return packed.mapInPandas(run, "path string, bytes long")


def read_meta(spark: SparkSession, folder: str) -> GridMeta:
    """The grid from the marker's name."""
    if not folder:
        raise ValueError("an input folder is required")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if "_info_" in f.base_name]
    if len(names) != 1:
        raise ValueError(f"{folder} has {len(names)} markers")
    m = spark.range(1).select(parse_info_name(F.lit(names[0])).alias("m")).first().m
    return GridMeta(m.nx * m.cx, m.ny * m.cy, m.nz * m.cz, m.cx, m.cy, m.cz, m.raster)


#: Fields of a 2D raster's metadata file, big-endian 32-bit integers in this order.
INFO2D = ("cell_rows", "cell_cols", "cell_row_size", "cell_col_size", "group_row_size", "group_col_size", "group_row_overlap", "group_col_overlap")
INFO2D_FILE = "info.dat"


def write_info2d(folder: str, **fields: int) -> None:
    """Writes the metadata file of a 2D raster; one small file, from the driver."""
    if set(fields) != set(INFO2D):
        raise ValueError(f"a 2D raster has the fields {INFO2D}")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{INFO2D_FILE}") as f:
        f.write(b"".join(int(fields[n]).to_bytes(4, "big", signed=True) for n in INFO2D))


def read_info2d(spark: SparkSession, folder: str) -> DataFrame:
    """One row with the fields of the metadata file below ``folder``."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{INFO2D_FILE}")
    whole = lambda k: F.conv(F.hex(F.substring("content", 4 * k + 1, 4)), 16, 10).cast("long")
    signed = lambda n: F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int")
    return files.select(*(signed(whole(k)).alias(n) for k, n in enumerate(INFO2D)))


def read_tiles(spark: SparkSession, folder: str, prefix: str = "r3d") -> DataFrame:
    """(raster, tx, ty, tz, path, content); whole files, chosen by name before they are opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*").load(folder)
    named = files.withColumn("t", parse_tile_name(F.col("path"))).where("t is not null")
    return named.select(F.col("t.raster").alias("raster"), F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), F.col("t.z").alias("tz"), "path", "content")


def read_raster(spark: SparkSession, folder: str, profile: VoxelProfile, prefix: str = "r3d") -> DataFrame:
    return unpack(read_tiles(spark, folder, prefix), read_meta(spark, folder), profile)


def voxel_records(voxels: DataFrame, profile: VoxelProfile, *, length_prefix: bool = False) -> DataFrame:
    """Adds ``record``: a voxel's own bytes, with its number of fields before them on request."""
    dtype, names = profile.dtype, profile.attributes

    def run(frames):
        for pdf in frames:
            out = np.empty(len(pdf), dtype)
            for n in names:
                out[n] = pdf[n]
            head = len(names).to_bytes(4, "big") if length_prefix else b""
            yield pdf.assign(record=[head + r.tobytes() for r in out])

    return voxels.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema) + ", record binary")


def read_spatial_info(spark: SparkSession, path: str) -> DataFrame:
    """(kind, gx, gy, gz, value) lines of a group table; shorter lines are skipped."""
    p = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(p) == 5)
    return rows.select(p[0].alias("kind"), *(p[i + 1].cast("int").alias(c) for i, c in enumerate(("gx", "gy", "gz"))), p[4].alias("value"))


def append_spatial_info(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", "kind", *(F.col(c).cast("string") for c in ("gx", "gy", "gz")), "value").alias("value")).write.mode("append").text(path)


def read_grid_index(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, replicas) lines; markers have row and col -1."""
    p = F.split("value", " ")
    return spark.read.text(path).where(F.size(p) >= 3).select(p[0].cast("int").alias("row"), p[1].cast("int").alias("col"), F.slice(p, 3, F.size(p) - 2).alias("replicas"))


def write_grid_index(placement: DataFrame, path: str, mode: str = "append") -> None:
    """Lines of placed tiles, and a marker line with the first replica of each later tile of row 0.

    With mode ``reset`` a table that has the tile (0, 0) begins the index anew, and others append.
    """
    if mode == "reset":
        mode = "append" if placement.where("row = 0 and col = 0").isEmpty() else "overwrite"
    line = F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.concat_ws(" ", "replicas"))
    marker = F.when((F.col("row") == 0) & (F.col("col") != 0), F.concat_ws(" ", F.lit("-1"), F.lit("-1"), F.col("replicas")[0]))
    placement.select(F.explode(F.array_compact(F.array(line, marker))).alias("value")).write.mode(mode).text(path)


def append_io_statistics(statistics: DataFrame, path: str) -> None:
    """Appends lines of the hour, window, and megabytes read in all and from other nodes.

    ``statistics`` has split_id, total_bytes and remote_bytes. What a store has really sent is
    not known to Spark, so these are the bytes that follow from the windows.
    """
    mb = lambda c: (F.col(c) / 1024.0 / 1024.0).cast("string")
    stamp = F.date_format(F.current_timestamp(), "yyyy/MM/dd|HH:mm")
    statistics.select(F.concat_ws(" ", stamp, F.col("split_id").cast("string"), mb("total_bytes"), mb("remote_bytes")).alias("value")).write.mode("append").text(path)


def read_io_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(at, split_id, total_mb, remote_mb) lines; others are skipped."""
    p = F.split("value", " ")
    return spark.read.text(path).where(F.size(p) == 4).select(F.to_timestamp(p[0], "yyyy/MM/dd|HH:mm").alias("at"), p[1].cast("long").alias("split_id"), p[2].cast("double").alias("total_mb"), p[3].cast("double").alias("remote_mb"))


def read_static_placement(spark: SparkSession, path: str) -> DataFrame:
    """(file, replicas); lines without exactly four fields are skipped."""
    p = F.split("value", " ")
    return spark.read.text(path).where(F.size(p) == 4).select(p[0].alias("file"), F.slice(p, 2, 3).alias("replicas"))


def read_pixel_text(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """A text raster of one value per line; whole files keep their order by name and line."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    lines = files.select("file", F.posexplode(F.filter(F.split("value", "\n"), lambda s: s != "")))
    counts = files.select("file", F.size(F.filter(F.split("value", "\n"), lambda s: s != "")).alias("n"))
    # one row per file: the running count is over files, not lines
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index = F.col("base") + F.col("pos")
    return lines.withColumnRenamed("col", "v").join(placed, "file").select(F.floor(index / cols).cast("int").alias("row"), (index % cols).cast("int").alias("col"), F.col("v").cast("int").alias("value"))
