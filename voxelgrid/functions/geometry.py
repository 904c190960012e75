"""Grid and group geometry as dataclasses on the driver and Column expressions on the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Seam windows are numbered from here on, where the main windows end below.
SEAM_BASE = 100_000


def _div(a: Column, b: int) -> Column:
    """Whole-number quotient of values that are not negative, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b)).cast("int")


@dataclass(frozen=True)
class GridMeta:
    """Voxels per axis, and the size of a tile. Border tiles may be smaller."""

    x: int
    y: int
    z: int
    cx: int
    cy: int
    cz: int = 1
    raster: str = "raster"

    def __post_init__(self):
        if min(self.x, self.y, self.z, self.cx, self.cy, self.cz) < 1:
            raise ValueError("grid and tile sizes must be positive")
        if "_" in self.raster:
            raise ValueError("a raster's name must not contain '_'")

    @property
    def nx(self) -> int:
        return -(-self.x // self.cx)

    @property
    def ny(self) -> int:
        return -(-self.y // self.cy)

    @property
    def nz(self) -> int:
        return -(-self.z // self.cz)

    @property
    def voxels(self) -> int:
        return self.x * self.y * self.z


@dataclass(frozen=True)
class GroupSpec:
    """Tiles per group along x (columns), y (rows) and z, and overlaps in tiles."""

    cols: int = 2
    rows: int = 2
    slabs: int = 2
    col_overlap: int = 1
    row_overlap: int = 1

    def __post_init__(self):
        if not 0 <= self.col_overlap < self.cols or min(self.rows, self.slabs) < 1:
            raise ValueError("overlap must be smaller than the group")

    @property
    def step(self) -> int:
        return self.cols - self.col_overlap

    def counts(self, meta: GridMeta) -> tuple[int, int, int]:
        gx = 1 if meta.nx <= self.cols else 1 - (-(meta.nx - self.cols) // self.step)
        return gx, -(-meta.ny // self.rows), -(-meta.nz // self.slabs)

    def seam_base(self, meta: GridMeta) -> int:
        """The number of the first seam window: SEAM_BASE, or above all main windows where these are more."""
        gx, gy, gz = self.counts(meta)
        return max(SEAM_BASE, gx * gy * gz)


def check_radius(meta: GridMeta, radius: int, *, halo_z: bool = True) -> None:
    """A window may reach no further than the neighbouring tile."""
    if radius < 1:
        raise ValueError("radius must be positive")
    if (meta.nx > 1 and 2 * radius >= meta.cx) or (meta.ny > 1 and 2 * radius >= meta.cy) or (halo_z and meta.nz > 1 and radius > meta.cz):
        raise ValueError(f"radius {radius} does not fit tiles of {meta.cx}x{meta.cy}x{meta.cz}")


def linear_index(meta: GridMeta, x: Column, y: Column, z: Column) -> Column:
    return x.cast("long") + y * F.lit(meta.x).cast("long") + z * F.lit(meta.x * meta.y).cast("long")


def coordinates(index: Column, x: int, y: int) -> tuple[Column, Column, Column]:
    """x, y and z of a linear index; x runs fastest."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return (index % x).cast("int"), (div(index, x) % y).cast("int"), div(index, x * y).cast("int")


def tile_of(meta: GridMeta, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return _div(x, meta.cx), _div(y, meta.cy), _div(z, meta.cz)


def main_group(spec: GroupSpec, tx: Column, ty: Column, tz: Column) -> tuple[Column, Column, Column]:
    """The group that a tile counts to; a shared column counts to the left one."""
    gx = F.when(tx < spec.cols, 0).otherwise(_div(tx - spec.cols, spec.step) + 1)
    return gx, _div(ty, spec.rows), _div(tz, spec.slabs)


def right_partner(meta: GridMeta, spec: GroupSpec, tx: Column, ty: Column, tz: Column) -> Column:
    """The group to the right that has the tile as well, or null."""
    gx, gy, gz = main_group(spec, tx, ty, tz)
    shared = (tx != 0) & (tx % spec.step < spec.col_overlap) & (tx != meta.nx - 1)
    return F.when(shared, F.struct((gx + 1).alias("x"), gy.alias("y"), gz.alias("z")))


def row_partners(meta: GridMeta, spec: GroupSpec, tx: Column, ty: Column, tz: Column) -> Column:
    """The seam groups that have the tile: of the seam above, of the seam below, of both, or none."""
    _, gy, gz = main_group(spec, tx, ty, tz)
    above = (ty % spec.rows < spec.row_overlap) & (gy != 0)
    below = (ty % spec.rows >= spec.rows - spec.row_overlap) & (ty != meta.ny - 1)
    one = lambda when, y: F.when(when, F.struct(F.lit(0).alias("x"), y.cast("int").alias("y"), gz.alias("z")))
    return F.array_compact(F.array(one(above, gy - 1), one(below, gy)))


def parse_tile_name(name: Column) -> Column:
    """struct(kind, raster, x, y, z) of a tile's file name or path, or null.

    ``grid_<raster>_<row>_<col>`` has its row first; the prefixes r3d, r3dsg and default take
    x, y and z.
    """
    p = F.split(F.element_at(F.split(name, "/"), -1), "_")
    number = lambda i: F.get(p, F.lit(i)).try_cast("int")
    flat = (F.size(p) == 4) & (p[0] == "grid")
    solid = (F.size(p) == 5) & p[0].isin("r3d", "r3dsg", "default")
    made = lambda x, y, z: F.struct(p[0].alias("kind"), p[1].alias("raster"), x.alias("x"), y.alias("y"), z.alias("z"))
    return F.when(flat, made(number(3), number(2), F.lit(0))).when(solid, made(number(2), number(3), number(4)))


def parse_info_name(name: Column) -> Column:
    """struct(prefix, nx, ny, nz, cx, cy, cz, raster) of a 3D marker's name, or null."""
    p = F.split(F.element_at(F.split(name, "/"), -1), "_")
    fields = [F.get(p, F.lit(i + 2)).try_cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz", "cx", "cy", "cz"))]
    return F.when((F.size(p) == 9) & (p[1] == "info"), F.struct(p[0].alias("prefix"), *fields, p[8].alias("raster")))


def parse_flat_info_name(name: Column) -> Column:
    """struct(rows, cols, row_size, col_size) of a 2D marker's name, or null."""
    p = F.split(F.element_at(F.split(name, "/"), -1), "_")
    fields = [F.get(p, F.lit(i + 1)).try_cast("int").alias(n) for i, n in enumerate(("rows", "cols", "row_size", "col_size"))]
    return F.when((F.size(p) == 5) & (p[0] == "info"), F.struct(*fields))


def raster_of_path(path: Column) -> Column:
    """The directory that holds a file, which names the raster."""
    return F.regexp_extract(path, "([^/]+)/[^/]*$", 1)


def classify_name(name: Column) -> Column:
    """Which placement rule a file falls under: marker, static, tile or ordinary."""
    p = F.split(F.element_at(F.split(name, "/"), -1), "_")
    return (
        F.when((F.size(p) == 9) & (p[0] == "r3d") & (p[1] == "info"), "marker")
        .when((F.size(p) == 5) & (p[0] == "r3dsg"), "static")
        .when((F.size(p) == 5) & (p[0] == "r3d"), "tile")
        .when((F.size(p) == 4) & (p[0] == "grid"), "tile")
        .otherwise("ordinary")
    )


def max_nodes_per_rack(replicas: Column, racks: Column) -> Column:
    most = F.floor((replicas - 1) / racks) + 2
    return F.when(racks <= 1, replicas).when(most == replicas, most - 1).otherwise(most).cast("int")
