"""Assembly of windows with halos from voxel rows.

The windows that a voxel belongs to follow from its coordinates, so assembly is an explode of
a few computed numbers and needs no join. ``by_range`` is the plain range join, for tests and
for window tables of other origin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, GroupSpec, check_radius, linear_index
from .windows import BOX


def _floor(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("int")


def _range(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _with_origin(rows: DataFrame, box: dict[str, Column], columns: list[str]) -> DataFrame:
    return rows.select("split_id", *columns, *((F.col(a) - box[f"{a}0"]).cast("int").alias(f"d{a}") for a in "xyz"))


def group_halo(voxels: DataFrame, meta: GridMeta, radius: int, spec: GroupSpec = GroupSpec(), *, halo_z: bool = True) -> DataFrame:
    """Voxels of all main and seam windows: split_id, the voxel's columns, and its place dx, dy, dz."""
    check_radius(meta, radius, halo_z=halo_z)
    gx, gy, gz = spec.counts(meta)
    rz = radius if halo_z else 0
    h, d = spec.rows * meta.cy, spec.slabs * meta.cz
    columns = voxels.columns
    tx = _floor(F.col("x"), meta.cx)
    cols = _range(F.greatest(F.lit(0), F.ceil((tx - spec.cols + 1) / spec.step).cast("int")), F.least(F.lit(gx - 1), _floor(tx, spec.step)))
    slabs = _range(_floor(F.greatest(F.lit(0), F.col("z") - rz), d), F.least(F.lit(gz - 1), _floor(F.col("z") + rz, d)))
    rows = voxels.withColumn("_gz", F.explode(slabs))
    first = lambda g: F.when(g == 0, 0).otherwise(g * spec.step * meta.cx + (meta.cx if spec.col_overlap else 0) - 2 * radius)
    # a seam window is a further candidate, numbered -1
    seam = _floor(F.col("y") + 2 * radius, h) - 1
    at_seam = (seam >= 0) & (seam < gy - 1) & (F.col("y") < (seam + 1) * h + 2 * radius)
    rows = rows.withColumn("_gx", F.explode(F.concat(F.filter(cols, lambda g: F.col("x") >= first(g)), F.when(at_seam, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))))
    is_seam = F.col("_gx") < 0
    main_id = F.col("_gx") + _floor(F.col("y"), h).cast("long") * gx + F.col("_gz").cast("long") * (gx * gy)
    split_id = F.when(is_seam, F.lit(spec.seam_base(meta)).cast("long") + F.col("_gz").cast("long") * (gy - 1) + seam).otherwise(main_id)
    box = {
        "x0": F.when(is_seam, 0).otherwise(first(F.col("_gx"))),
        "y0": F.when(is_seam, (seam + 1) * h - 2 * radius).otherwise(_floor(F.col("y"), h) * h),
        "z0": F.greatest(F.lit(0), F.col("_gz") * d - rz),
    }
    return _with_origin(rows.withColumn("split_id", split_id.cast("long")), box, columns)


def tile_halo(voxels: DataFrame, meta: GridMeta, radius: int) -> DataFrame:
    """Voxels of all per-tile windows."""
    columns = voxels.columns
    near = lambda a, size, n: F.explode(_range(_floor(F.greatest(F.lit(0), F.col(a) - radius), size), F.least(F.lit(n - 1), _floor(F.col(a) + radius, size))))
    rows = voxels.withColumn("_wz", near("z", meta.cz, meta.nz)).withColumn("_wy", near("y", meta.cy, meta.ny)).withColumn("_wx", near("x", meta.cx, meta.nx))
    split_id = F.col("_wx") + F.col("_wy") * meta.nx + F.col("_wz") * (meta.nx * meta.ny)
    box = {f"{a}0": F.greatest(F.lit(0), F.col(f"_w{a}") * size - radius) for a, size in (("x", meta.cx), ("y", meta.cy), ("z", meta.cz))}
    return _with_origin(rows.withColumn("split_id", split_id.cast("long")), box, columns)


def ordinary2d_halo(pixels: DataFrame, meta: GridMeta, radius: int) -> DataFrame:
    """Pixels (x, y, z = 0) of the windows with halos to the right and below."""
    columns = pixels.columns
    near = lambda a, size: F.explode(_range(_floor(F.greatest(F.lit(0), F.col(a) - 2 * radius), size), _floor(F.col(a), size)))
    rows = pixels.withColumn("_wy", near("y", meta.cy)).withColumn("_wx", near("x", meta.cx))
    box = {"x0": F.col("_wx") * meta.cx, "y0": F.col("_wy") * meta.cy, "z0": F.lit(0)}
    return _with_origin(rows.withColumn("split_id", (F.col("_wx") + F.col("_wy") * meta.nx).cast("long")), box, columns)


def quadrant2d_halo(pixels: DataFrame, meta: GridMeta, radius: int) -> DataFrame:
    """Pixels of the windows around inner tile corners."""
    columns = pixels.columns

    def first(t, size):
        return F.when(t == 0, 0).otherwise(t * size + size // 2 - radius)

    def near(a, size, n):
        t = _floor(F.col(a), size)
        some = _range(F.greatest(F.lit(0), t - 2), F.least(F.lit(n - 2), t + 1))
        return F.explode(F.filter(some, lambda k: (F.col(a) >= first(k, size)) & ((k == n - 2) | (F.col(a) < (k + 1) * size + size // 2 + radius))))

    rows = pixels.withColumn("_wy", near("y", meta.cy, meta.ny)).withColumn("_wx", near("x", meta.cx, meta.nx))
    box = {"x0": first(F.col("_wx"), meta.cx), "y0": first(F.col("_wy"), meta.cy), "z0": F.lit(0)}
    return _with_origin(rows.withColumn("split_id", (F.col("_wx") + F.col("_wy") * meta.nx).cast("long")), box, columns)


def by_range(voxels: DataFrame, windows: DataFrame) -> DataFrame:
    """The same by a range join with a window table."""
    inside = [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in "xyz"]
    rows = voxels.join(windows.select("split_id", *BOX), inside[0] & inside[1] & inside[2])
    return _with_origin(rows, {f"{a}0": F.col(f"{a}0") for a in "xyz"}, voxels.columns)


def blocks(assembled: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per window: its size and the values of each attribute in raster order.

    A window is bounded by its layout, and so is the row.
    """
    cell = F.struct("dz", "dy", "dx", *attributes)
    rows = assembled.groupBy("split_id").agg(F.array_sort(F.collect_list(cell)).alias("c"), *((F.max(f"d{a}") + 1).alias(f"n{a}") for a in "xyz"))
    return rows.select("split_id", "nx", "ny", "nz", *(F.col(f"c.{a}").alias(a) for a in attributes))


def unblock(rows: DataFrame, windows: DataFrame, attributes: list[str]) -> DataFrame:
    """Voxels of block rows, by the windows they belong to."""
    zipped = rows.select("split_id", "nx", "ny", F.posexplode(F.arrays_zip(*attributes)).alias("i", "v")).join(windows.select("split_id", *BOX), "split_id")
    x, y, z = F.col("i") % F.col("nx"), F.floor(F.col("i") / F.col("nx")) % F.col("ny"), F.floor(F.col("i") / (F.col("nx") * F.col("ny")))
    return zipped.select("split_id", *((c + F.col(f"{a}0")).cast("int").alias(a) for a, c in (("x", x), ("y", y), ("z", z))), *(F.col(f"v.{a}").alias(a) for a in attributes))


def stencil(assembled: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's analysis: ``fn`` takes a window's voxels as a pandas frame and returns one."""
    return assembled.groupBy("split_id").applyInPandas(fn, schema)


def stencil_mean(voxels: DataFrame, meta: GridMeta, radius: int, attribute: str, spec: GroupSpec = GroupSpec()) -> DataFrame:
    """Sum and count of each voxel's clipped box of a radius, computed window by window.

    A voxel's value is taken from a window that holds its whole box; all such agree.
    """
    import numpy as np
    import pandas as pd

    r = radius

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = [int(pdf[f"d{a}"].max()) + 1 for a in "zyx"]
        origin = [int((pdf[a] - pdf[f"d{a}"]).iloc[0]) for a in "zyx"]
        v = np.zeros(size, np.int64)
        v[pdf.dz, pdf.dy, pdf.dx] = pdf[attribute]
        c = np.zeros([s + 1 for s in size], np.int64)
        c[1:, 1:, 1:] = v.cumsum(0).cumsum(1).cumsum(2)
        at = [pdf[f"d{a}"].to_numpy() for a in "zyx"]
        lo = [np.maximum(0, i - r) for i in at]
        hi = [np.minimum(s, i + r + 1) for i, s in zip(at, size, strict=True)]
        total = sum((1 if (i + j + k) % 2 else -1) * c[(lo[0], hi[0])[i], (lo[1], hi[1])[j], (lo[2], hi[2])[k]] for i in (0, 1) for j in (0, 1) for k in (0, 1))
        n = np.prod([b - a for a, b in zip(lo, hi, strict=True)], axis=0)
        most = (meta.z, meta.y, meta.x)
        whole = np.all([(o + i - r >= o) | (o == 0) for o, i in zip(origin, at, strict=True)], axis=0) & np.all([(i + r + 1 <= s) | (o + s == m) for o, i, s, m in zip(origin, at, size, most, strict=True)], axis=0)
        return pd.DataFrame({"x": pdf.x, "y": pdf.y, "z": pdf.z, "total": total, "n": n})[whole]

    found = stencil(group_halo(voxels.select("x", "y", "z", attribute), meta, radius, spec), run, "x int, y int, z int, total long, n long")
    return found.groupBy("x", "y", "z").agg(F.min("total").alias("total"), F.min("n").alias("n"))


def index_of(meta: GridMeta) -> Column:
    return linear_index(meta, F.col("x"), F.col("y"), F.col("z"))
