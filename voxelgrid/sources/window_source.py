"""A Spark data source of windows: a partition is a window, and its task opens the tiles it needs.

Halos are read twice instead of shuffled. Of a tile only the rows inside a window's box are read,
and a window goes out some layers at a time, so that a task never holds it whole.

    spark.dataSource.register(VoxelWindowSource)
    spark.read.format("voxelwindow").option("path", uri).option("radius", 2).load()
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import GridMeta, GroupSpec, check_radius
from ..functions.profiles import DEFAULT, profile


#: Voxels of a batch, about.
CELLS = 1_000_000


def tile_rows(f: pa.NativeFile, meta: GridMeta, dtype: np.dtype, layers: tuple[int, int], rows: tuple[int, int]) -> np.ndarray:
    """Some rows of some layers of a tile, by seeks: one read where the layers are whole, else one a layer."""
    row = meta.cx * dtype.itemsize
    n = rows[1] - rows[0]
    parts = [(layers[0], layers[1] - layers[0])] if n == meta.cy else [(k, 1) for k in range(*layers)]
    out = []
    for first, many in parts:
        f.seek((first * meta.cy + rows[0]) * row)
        out.append(f.read(many * n * row))
    return np.frombuffer(b"".join(out), dtype).reshape(layers[1] - layers[0], n, meta.cx)


class WindowPartition(InputPartition):
    def __init__(self, split_id: int, box: tuple[int, ...]):
        super().__init__(split_id)
        self.split_id, self.box = split_id, box


def boxes(meta: GridMeta, radius: int, spec: GroupSpec) -> list[tuple[int, tuple[int, ...]]]:
    """Numbers and boxes of main and seam windows."""
    check_radius(meta, radius)
    gx, gy, gz = spec.counts(meta)
    w, h, d = spec.cols * meta.cx, spec.rows * meta.cy, spec.slabs * meta.cz
    out = []
    for c in range(gz):
        z = max(0, c * d - radius), min((c + 1) * d + radius, meta.z)
        for b in range(gy):
            for a in range(gx):
                at = a * spec.step * meta.cx
                x0 = 0 if a == 0 else at + (meta.cx if spec.col_overlap else 0) - 2 * radius
                out.append((a + b * gx + c * gx * gy, (x0, min(at + w, meta.x), b * h, min((b + 1) * h, meta.y), *z)))
        for b in range(gy - 1):
            y = (b + 1) * h
            out.append((spec.seam_base(meta) + c * (gy - 1) + b, (0, meta.x, y - 2 * radius, min(y + 2 * radius, meta.y), *z)))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("option 'path' is required")
        self.prefix = options.get("prefix", "r3d")
        self.profile = profile(options.get("profile", DEFAULT.name))
        self.radius = int(options.get("radius", 10))
        self.spec = GroupSpec(cols=int(options.get("groupCols", 2)), rows=int(options.get("groupRows", 2)), slabs=int(options.get("groupSlabs", 2)))
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        markers = [f.base_name.split("_") for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.base_name.startswith(f"{self.prefix}_info_")]
        if len(markers) != 1 or len(markers[0]) != 9:
            raise ValueError(f"{self.path} has no marker with prefix {self.prefix!r}")
        nx, ny, nz, cx, cy, cz = map(int, markers[0][2:8])
        self.meta = GridMeta(nx * cx, ny * cy, nz * cz, cx, cy, cz, markers[0][8])

    def partitions(self):
        return [WindowPartition(*b) for b in boxes(self.meta, self.radius, self.spec)]

    def read(self, partition: WindowPartition):
        """A window's voxels, some layers at a time; only the rows that it needs are read from a tile."""
        x0, x1, y0, y1, z0, z1 = partition.box
        layers = max(1, CELLS // ((x1 - x0) * (y1 - y0)))
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        for lo in range(z0, z1, layers):
            yield self._batch(partition, self._slab(fs, base, (x0, x1, y0, y1, lo, min(lo + layers, z1))), lo)

    def _slab(self, fs: pyarrow.fs.FileSystem, base: str, box: tuple[int, ...]) -> np.ndarray:
        m, dtype = self.meta, self.profile.dtype
        x0, x1, y0, y1, z0, z1 = box
        block = np.empty((z1 - z0, y1 - y0, x1 - x0), dtype)
        for tz in range(z0 // m.cz, (z1 - 1) // m.cz + 1):
            for ty in range(y0 // m.cy, (y1 - 1) // m.cy + 1):
                for tx in range(x0 // m.cx, (x1 - 1) // m.cx + 1):
                    lo = [max(a, t * c) for a, t, c in ((z0, tz, m.cz), (y0, ty, m.cy), (x0, tx, m.cx))]
                    hi = [min(a, (t + 1) * c) for a, t, c in ((z1, tz, m.cz), (y1, ty, m.cy), (x1, tx, m.cx))]
                    at = [(a - t * c, b - t * c) for a, b, t, c in zip(lo, hi, (tz, ty, tx), (m.cz, m.cy, m.cx), strict=True)]
                    with fs.open_input_file(f"{base}/{self.prefix}_{m.raster}_{tx}_{ty}_{tz}") as f:
                        if f.size() != m.cz * m.cy * m.cx * dtype.itemsize:
                            raise ValueError(f"tile {tx},{ty},{tz} has {f.size()} bytes")
                        part = tile_rows(f, m, dtype, at[0], at[1])
                    to = tuple(slice(a - o, b - o) for a, b, o in zip(lo, hi, (z0, y0, x0), strict=True))
                    block[to] = part[:, :, slice(*at[2])]
        return block

    def _batch(self, partition: WindowPartition, block: np.ndarray, z: int) -> pa.RecordBatch:
        x0, _, y0, _, z0, _ = partition.box
        dz, dy, dx = np.indices(block.shape, np.int32).reshape(3, -1)
        dz += z - z0
        flat = block.reshape(-1)
        cells = [pa.array(np.full(len(flat), partition.split_id, np.int64)), *(pa.array(v) for v in (x0 + dx, y0 + dy, z0 + dz, dx, dy, dz))]
        kinds = {"smallint": pa.int16(), "int": pa.int32(), "float": pa.float32()}
        values = [pa.array(flat[n].astype(flat[n].dtype.newbyteorder("="))).cast(kinds[s]) for n, _, s in self.profile.fields]
        return pa.RecordBatch.from_arrays([*cells, *values], names=["split_id", "x", "y", "z", "dx", "dy", "dz", *self.profile.attributes])


class VoxelWindowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxelwindow"

    def schema(self) -> str:
        return "split_id long, x int, y int, z int, dx int, dy int, dz int, " + profile(self.options.get("profile", DEFAULT.name)).ddl()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
