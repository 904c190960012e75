"""Synthetic rasters as expressions over a range; nothing is held on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, coordinates


def raster(spark: SparkSession, meta: GridMeta, attributes: dict[str, Column]) -> DataFrame:
    """x, y, z and one column per expression over ``id``, the linear index."""
    x, y, z = coordinates(F.col("id"), meta.x, meta.y)
    return spark.range(meta.voxels).select(x.alias("x"), y.alias("y"), z.alias("z"), *(c.alias(n) for n, c in attributes.items()))


def _wave() -> Column:
    return (F.col("id") % 128).cast("smallint")


def simple(spark: SparkSession, meta: GridMeta) -> DataFrame:
    return raster(spark, meta, {"attr1": _wave()})


def normal(spark: SparkSession, meta: GridMeta) -> DataFrame:
    ten = F.lit(10).cast("smallint")
    return raster(spark, meta, {"attr1": _wave()} | {f"attr{k}": ten for k in range(2, 11)})


def geology(spark: SparkSession, meta: GridMeta) -> DataFrame:
    v = _wave().cast("float")
    parts = {n: (v / F.lit(float(k)).cast("float")).cast("float") for n, k in (("moisture", 3), ("hazard", 4), ("uncertainty", 5))}
    return raster(spark, meta, {"stratum": _wave(), "lithology": _wave()} | parts)


def pixels(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """A 2D raster whose value is the linear index."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").cast("int").alias("value"))


def write_pixel_text(pixels_: DataFrame, path: str) -> None:
    """One value a line, lines in raster order over ordered files."""
    pixels_.repartitionByRange("row", "col").sortWithinPartitions("row", "col").select(F.col("value").cast("string").alias("value")).write.text(path)
