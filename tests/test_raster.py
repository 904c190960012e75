"""Geometry properties, placement rules, tile files and the window source."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrid.functions.geometry import GridMeta, GroupSpec, check_radius
from voxelgrid.functions.profiles import GEOLOGY, NORMAL, SIMPLE, profile
from voxelgrid.operators import algebra, halo, windows
from voxelgrid.plans import placement
from voxelgrid.sources import generate, tiles
from voxelgrid.sources.window_source import VoxelWindowSource, boxes

NODES = [placement.Node(f"n{k:02d}", "/r1" if k < 7 else "/r2") for k in range(19)]


@pytest.mark.parametrize("n", [(3, 4, 4), (4, 5, 3), (1, 1, 1), (2, 2, 2), (1, 4, 2), (5, 3, 5)])
def test_every_neighbourhood_is_in_a_window(n):
    meta = GridMeta(n[0] * 10, n[1] * 10, n[2] * 10, 10, 10, 10)
    found = boxes(meta, 2, GroupSpec())
    assert len({i for i, _ in found}) == len(found)
    b = np.array([box for _, box in found])
    for x in range(0, meta.x, 3):
        for y in range(0, meta.y, 3):
            for z in range(0, meta.z, 3):
                lo = np.maximum(0, [x - 2, y - 2, z - 2])
                hi = np.minimum([meta.x, meta.y, meta.z], [x + 3, y + 3, z + 3])
                assert ((b[:, [0, 2, 4]] <= lo).all(1) & (b[:, [1, 3, 5]] >= hi).all(1)).any(), (x, y, z)


def test_explode_equals_range_join(spark):
    meta = GridMeta(24, 20, 12, 6, 5, 4)
    voxels = generate.simple(spark, meta)
    w = windows.group_windows(spark, meta, 2)
    a, b = halo.group_halo(voxels, meta, 2), halo.by_range(voxels, w)
    assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_radius_must_fit():
    with pytest.raises(ValueError, match="radius"):
        check_radius(GridMeta(20, 20, 20, 5, 5, 5), 3)
    with pytest.raises(ValueError, match="profile"):
        profile("unknown")


@pytest.mark.parametrize("grid", [(8, 12, 4), (7, 6, 4), (4, 5, 3)])
def test_group_plan(grid):
    meta = GridMeta(grid[0], grid[1], grid[2], 1, 1, 1)
    plan = placement.plan_groups(meta, NODES)
    at = {r[:4]: r[4] for r in plan}
    for (kind, x, y, z), node in at.items():
        if kind == "MG":
            assert node != at.get(("MG", x - 1, y, z))
            assert node not in (at.get(("OR", 0, y, z)), at.get(("OR", 0, y - 1, z)))
    counts = Counter(r[4] for r in plan)
    assert max(counts.values()) - min(counts.get(n.name, 0) for n in NODES) <= 1


def test_tile_replicas(spark):
    rows = placement.plan_tile_replicas(spark, GridMeta(40, 50, 40, 10, 10, 10), NODES).collect()
    rack = {n.name: n.rack for n in NODES}
    assert len(rows) == 80
    for r in rows:
        assert len(set(r.replicas)) == 3
    assert all(len({rack[n] for n in r.replicas}) == 2 for r in rows if r.tx in (0, 3) and r.ty in (0,))


def test_column_chain():
    rows = {(r, c): reps for r, c, reps in placement.column_chain(3, 150, NODES, "n00")}
    rack = {n.name: n.rack for n in NODES}
    first = rows[0, 0]
    assert first[0] == "n00" and rack[first[0]] != rack[first[1]] and rack[first[1]] == rack[first[2]]
    for c in range(1, 150):
        assert rows[0, c][0] == rows[0, c - 1][1]
        assert rows[2, c][:2] == rows[0, c][:2] and len(set(rows[2, c])) == 3
    counts = Counter(rows[0, c][1] for c in range(150))
    for r in ("/r1", "/r2"):
        own = [counts.get(n.name, 0) for n in NODES if n.rack == r]
        assert max(own) - min(own) < 2


@pytest.mark.parametrize(("made", "kind"), [(generate.simple, SIMPLE), (generate.normal, NORMAL), (generate.geology, GEOLOGY)])
def test_tile_files(spark, tmp_path, made, kind):
    meta = GridMeta(12, 10, 8, 6, 5, 4, "demo")
    voxels = made(spark, meta)
    folder = f"file://{tmp_path}/demo"
    files = tiles.write_tiles(voxels, meta, kind, folder).collect()
    assert len(files) == 8 and all(f.bytes == 120 * kind.voxel_bytes for f in files)
    assert tiles.read_meta(spark, folder) == meta
    back = tiles.read_raster(spark, folder, kind)
    assert back.exceptAll(voxels).isEmpty() and back.count() == meta.voxels
    spark.dataSource.register(VoxelWindowSource)
    source = spark.read.format("voxelwindow").options(path=folder, radius="2", profile=kind.name).load()
    want = halo.group_halo(voxels, meta, 2).select(source.columns)
    assert source.exceptAll(want).isEmpty() and want.exceptAll(source).isEmpty()


def test_text_tables(spark, tmp_path):
    placed = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["b", "c", "d"])], "row int, col int, replicas array<string>")
    tiles.write_grid_index(placed, f"{tmp_path}/grid")
    got = {(r.row, r.col, tuple(r.replicas)) for r in tiles.read_grid_index(spark, f"{tmp_path}/grid").collect()}
    assert got == {(0, 0, ("a", "b", "c")), (0, 1, ("b", "c", "d")), (-1, -1, ("b",))}
    info = placement.group_table(spark, GridMeta(40, 40, 40, 10, 10, 10, "m"), NODES)
    tiles.append_spatial_info(info, f"{tmp_path}/info")
    assert tiles.read_spatial_info(spark, f"{tmp_path}/info").count() == info.count()
    pixels = generate.pixels(spark, 7, 9)
    generate.write_pixel_text(pixels, f"{tmp_path}/px")
    assert tiles.read_pixel_text(spark, f"{tmp_path}/px", 9).exceptAll(pixels).isEmpty()


def test_blocks_round_trip(spark):
    meta = GridMeta(12, 10, 8, 6, 5, 4)
    made = halo.group_halo(generate.simple(spark, meta), meta, 2)
    back = halo.unblock(halo.blocks(made, ["attr1"]), windows.group_windows(spark, meta, 2), ["attr1"])
    assert back.exceptAll(made.select(back.columns)).isEmpty()


def test_empty_raster(spark):
    meta = GridMeta(8, 8, 8, 4, 4, 4)
    none = generate.simple(spark, meta).where(F.lit(False))
    assert algebra.block_average(none, meta, 1, ["attr1"]).isEmpty()
    assert halo.tile_halo(none, meta, 1).isEmpty()
