"""Window tables: one row (split_id, kind, x0, x1, y0, y1, z0, z1) per window of a layout.

Windows are computed from their number over a range, so a table of any size is made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, GroupSpec, check_radius

BOX = ["x0", "x1", "y0", "y1", "z0", "z1"]


def _i(c) -> Column:
    return c.cast("int")


def _split(n: Column, *sizes: int) -> list[Column]:
    out = []
    for s in sizes:
        out.append(_i(n % s))
        n = F.floor(n / s)
    return [*out, _i(n)]


def _table(rows: DataFrame, kind: str, split_id: Column, box: list[Column], extra: list[Column]) -> DataFrame:
    return rows.select(split_id.cast("long").alias("split_id"), F.lit(kind).alias("kind"), *extra, *(_i(c).alias(n) for n, c in zip(BOX, box, strict=True)))


def group_windows(spark: SparkSession, meta: GridMeta, radius: int, spec: GroupSpec = GroupSpec(), *, halo_z: bool = True) -> DataFrame:
    """Main windows (MG) over groups that overlap along x, and seam windows (OR) between group rows."""
    check_radius(meta, radius, halo_z=halo_z)
    gx, gy, gz = spec.counts(meta)
    rz = radius if halo_z else 0
    w, h, d = spec.cols * meta.cx, spec.rows * meta.cy, spec.slabs * meta.cz
    z = lambda g: [F.greatest(F.lit(0), g * d - rz), F.least((g + 1) * d + rz, F.lit(meta.z))]
    a, b, c = _split(F.col("id"), gx, gy)
    x0 = F.when(a == 0, 0).otherwise(a * spec.step * meta.cx + (meta.cx if spec.col_overlap else 0) - 2 * radius)
    box = [x0, F.least(a * spec.step * meta.cx + w, F.lit(meta.x)), b * h, F.least((b + 1) * h, F.lit(meta.y)), *z(c)]
    place = [a.alias("gx"), b.alias("gy"), c.alias("gz")]
    main = _table(spark.range(gx * gy * gz), "MG", F.col("id"), box, place)
    if gy == 1:
        return main
    b, c = _split(F.col("id"), gy - 1)
    seam = (b + 1) * h
    box = [F.lit(0), F.lit(meta.x), seam - 2 * radius, F.least(seam + 2 * radius, F.lit(meta.y)), *z(c)]
    place = [F.lit(0).alias("gx"), b.alias("gy"), c.alias("gz")]
    return main.unionByName(_table(spark.range((gy - 1) * gz), "OR", F.col("id") + spec.seam_base(meta), box, place))


def tile_windows(spark: SparkSession, meta: GridMeta, radius: int) -> DataFrame:
    """One window per tile with a halo on all sides."""
    a, b, c = _split(F.col("id"), meta.nx, meta.ny)
    side = lambda t, size, most: [F.greatest(F.lit(0), t * size - radius), F.least((t + 1) * size + radius, F.lit(most))]
    box = [*side(a, meta.cx, meta.x), *side(b, meta.cy, meta.y), *side(c, meta.cz, meta.z)]
    return _table(spark.range(meta.nx * meta.ny * meta.nz), "TILE", F.col("id"), box, [a.alias("gx"), b.alias("gy"), c.alias("gz")])


def ordinary2d_windows(spark: SparkSession, meta: GridMeta, radius: int) -> DataFrame:
    """One window per 2D tile with a halo to the right and below."""
    a, b, _ = _split(F.col("id"), meta.nx, meta.ny)
    side = lambda t, size, most: [t * size, F.least((t + 1) * size + 2 * radius, F.lit(most))]
    box = [*side(a, meta.cx, meta.x), *side(b, meta.cy, meta.y), F.lit(0), F.lit(1)]
    return _table(spark.range(meta.nx * meta.ny), "TILE", F.col("id"), box, [a.alias("gx"), b.alias("gy"), F.lit(0).alias("gz")])


def quadrant2d_windows(spark: SparkSession, meta: GridMeta, radius: int) -> DataFrame:
    """One window around each inner tile corner, from tile centre to tile centre and a radius on."""
    if meta.nx < 2 or meta.ny < 2:
        raise ValueError("quadrant windows need two tiles along each axis")
    a, b = _split(F.col("id"), meta.nx - 1)

    def side(t, size, n, most):
        return [F.when(t == 0, 0).otherwise(t * size + size // 2 - radius), F.when(t == n - 2, most).otherwise((t + 1) * size + size // 2 + radius)]

    box = [*side(a, meta.cx, meta.nx, meta.x), *side(b, meta.cy, meta.ny, meta.y), F.lit(0), F.lit(1)]
    return _table(spark.range((meta.nx - 1) * (meta.ny - 1)), "QUAD", a + b * meta.nx, box, [a.alias("gx"), b.alias("gy"), F.lit(0).alias("gz")])


def window_tiles(windows: DataFrame, meta: GridMeta) -> DataFrame:
    """(split_id, kind, tx, ty, tz) of all tiles that a window touches."""
    along = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int")))
    rows = windows.select("split_id", "kind", "gz", *BOX).withColumn("tz", along("z0", "z1", meta.cz))
    rows = rows.withColumn("ty", along("y0", "y1", meta.cy)).withColumn("tx", along("x0", "x1", meta.cx))
    return rows.select("split_id", "kind", "gz", "tx", "ty", "tz")


def main_tiles(windows: DataFrame, meta: GridMeta, spec: GroupSpec = GroupSpec()) -> DataFrame:
    """Those that lie in the window's own slabs, not in its halo along z."""
    return window_tiles(windows, meta).where(F.floor(F.col("tz") / spec.slabs) == F.col("gz"))


def tile_neighbourhood(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """(tx, ty, tz, nx, ny, nz): each tile with the up to 27 tiles around and including it."""
    a, b, c = _split(F.col("id"), meta.nx, meta.ny)
    rows = spark.range(meta.nx * meta.ny * meta.nz).select(a.alias("tx"), b.alias("ty"), c.alias("tz"))
    for t, n, most in (("tx", "nx", meta.nx), ("ty", "ny", meta.ny), ("tz", "nz", meta.nz)):
        rows = rows.withColumn(n, F.explode(F.sequence(F.greatest(F.col(t) - 1, F.lit(0)), F.least(F.col(t) + 1, F.lit(most - 1)))))
    return rows
