"""Resampling, slicing and merging of voxel rows.

Averages are algebraic: partial sums are combined, so they shuffle one row per block and task
and need no halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, linear_index


def _block(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def _mean(attribute: str, mode: str, n: Column) -> Column:
    if mode == "byte":
        return ((F.sum(F.col(attribute).cast("long")) - F.sum(F.col(attribute).cast("long")) % n) / n).cast("long") % 128
    if mode == "legacy":
        s = F.sum(F.floor(F.col(attribute)).cast("long"))
        return ((s - s % n) / n).cast("long") % 128
    return F.sum(F.col(attribute).cast("double")) / n


def block_average(voxels: DataFrame, meta: GridMeta, radius: int, attributes: list[str], *, mode: str = "byte") -> DataFrame:
    """Means over blocks of (2 radius) cubed voxels; incomplete border blocks are left out.

    ``byte`` truncates to whole numbers modulo 128, ``exact`` gives doubles, and ``legacy``
    adds up whole parts first (for values that are not negative).
    """
    if mode not in ("byte", "exact", "legacy"):
        raise ValueError(f"unknown mode {mode!r}")
    side = 2 * radius
    inside = (F.col("x") < meta.x // side * side) & (F.col("y") < meta.y // side * side) & (F.col("z") < meta.z // side * side)
    blocks = voxels.where(inside).groupBy(*(_block(a, side).alias(f"b{a}") for a in "xyz"))
    return blocks.agg(*(_mean(a, mode, F.lit(side**3)).alias(a) for a in attributes))


def sliding_z_average(voxels: DataFrame, meta: GridMeta, radius: int, attributes: list[str], *, mode: str = "byte", resample: bool = True) -> DataFrame:
    """Block means along x and y, over slabs of 2 radius layers that advance by one radius along z.

    Without ``resample`` the slabs themselves: (layer, x, y, z, attributes), z within the slab.
    """
    side = 2 * radius
    inside = (F.col("x") < meta.x // side * side) & (F.col("y") < meta.y // side * side)
    step = _block("z", radius)
    whole = F.filter(F.array(step, step - 1), lambda k: (k >= 0) & (k * radius + side <= meta.z))
    if not resample:
        rows = voxels.withColumn("layer", F.explode(whole))
        return rows.select("layer", "x", "y", (F.col("z") - F.col("layer") * radius).alias("z"), *attributes)
    rows = voxels.where(inside).withColumn("layer", F.explode(whole))
    blocks = rows.groupBy(_block("x", side).alias("bx"), _block("y", side).alias("by"), "layer")
    return blocks.agg(*(_mean(a, mode, F.lit(side**3)).alias(a) for a in attributes))


def box_slice(voxels: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """The voxels of a half-open box, in its own coordinates."""
    rows = voxels
    for a, (lo, hi) in (("x", x), ("y", y), ("z", z)):
        rows = rows.where((F.col(a) >= lo) & (F.col(a) < hi))
    return rows.withColumns({a: F.col(a) - lo for a, (lo, _) in (("x", x), ("y", y), ("z", z))})


def z_region(voxels: DataFrame, start: int, end: int) -> DataFrame:
    return voxels.where((F.col("z") >= start) & (F.col("z") < end)).withColumn("z", F.col("z") - start)


def slab_shift(voxels: DataFrame, meta: GridMeta, start: int, *, keep_tail: bool = True) -> DataFrame:
    """Moves the layers from ``start`` on to the front; the tail keeps its old values, or goes."""
    moved = voxels.where(F.col("z") >= start).withColumn("z", F.col("z") - start)
    return moved.unionByName(voxels.where(F.col("z") >= meta.z - start)) if keep_tail else moved


def z_merge(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Blocks of equal x and y, given with their depths, on top of each other."""
    if not parts:
        raise ValueError("nothing to merge")
    out, base = None, 0
    for df, depth in parts:
        one = df.withColumn("z", F.col("z") + base)
        out = one if out is None else out.unionByName(one)
        base += depth
    return out


def attributes(voxels: DataFrame, names: list[str]) -> DataFrame:
    return voxels.select("x", "y", "z", *names)


def point_read(voxels: DataFrame, x: int, y: int, z: int) -> DataFrame:
    return voxels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))


def point_write(voxels: DataFrame, meta: GridMeta, index: int, values: dict[str, int]) -> DataFrame:
    """All voxels, with new values for the one of a linear index."""
    here = linear_index(meta, F.col("x"), F.col("y"), F.col("z")) == index
    return voxels.withColumns({n: F.when(here, F.lit(v).cast(voxels.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items()})
