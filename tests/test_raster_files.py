"""Partial reads of tile files, metadata and statistics files, and placement rules at their edges."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelgrid.functions.geometry import GridMeta
from voxelgrid.functions.profiles import SIMPLE
from voxelgrid.operators import audit, halo
from voxelgrid.plans import placement
from voxelgrid.sources import generate, tiles, window_source


def test_windows_go_out_in_layers_and_read_parts(spark, tmp_path, monkeypatch):
    meta = GridMeta(20, 24, 16, 5, 8, 8, "demo")
    voxels = generate.simple(spark, meta)
    folder = f"file://{tmp_path}/demo"
    tiles.write_tiles(voxels, meta, SIMPLE, folder).collect()
    read, whole = Counter(), window_source.tile_rows

    def counted(f, m, dtype, layers, rows):
        part = whole(f, m, dtype, layers, rows)
        read["bytes"] += part.nbytes
        return part

    monkeypatch.setattr(window_source, "tile_rows", counted)
    monkeypatch.setattr(window_source, "CELLS", 300)
    reader = window_source._Reader({"path": folder, "radius": "1", "profile": SIMPLE.name, "groupSlabs": "1"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= 300 and len(batches) > len(reader.partitions())
    got = Counter(zip(*(c.to_pylist() for c in pa.Table.from_batches(batches).columns), strict=True))
    want = halo.group_halo(voxels, meta, 1, reader.spec).select(batches[0].schema.names).collect()
    assert got == Counter(tuple(r) for r in want)
    # some rows are read whole although a window needs a part of them; never whole tiles
    delivered = sum(got.values()) * SIMPLE.voxel_bytes
    opened = audit.input_files(window_tiles_of(spark, meta, reader.spec)).first().opens * 320 * SIMPLE.voxel_bytes
    assert delivered <= read["bytes"] < opened and read["bytes"] <= 1.6 * delivered


def window_tiles_of(spark, meta, spec):
    from voxelgrid.operators import windows

    return windows.window_tiles(windows.group_windows(spark, meta, 1, spec), meta)


def test_a_short_tile_is_an_error(spark, tmp_path):
    meta = GridMeta(10, 10, 10, 5, 5, 5, "demo")
    tiles.write_tiles(generate.simple(spark, meta), meta, SIMPLE, f"file://{tmp_path}/d").collect()
    (tmp_path / "d" / "r3d_demo_0_0_0").write_bytes(b"short")
    reader = window_source._Reader({"path": f"file://{tmp_path}/d", "radius": "1", "profile": SIMPLE.name})
    with pytest.raises(ValueError, match="0,0,0"):
        list(reader.read(reader.partitions()[0]))


def test_metadata_of_2d_rasters(spark, tmp_path):
    fields = dict(zip(tiles.INFO2D, (9, 9, 3000, 3000, 3, 3, 1, -1), strict=True))
    tiles.write_info2d(f"file://{tmp_path}/two", **fields)
    assert (tmp_path / "two" / "info.dat").read_bytes() == b"".join(v.to_bytes(4, "big", signed=True) for v in fields.values())
    assert tiles.read_info2d(spark, f"file://{tmp_path}/two").first().asDict() == fields
    with pytest.raises(ValueError):
        tiles.write_info2d(f"file://{tmp_path}/two", cell_rows=1)


def test_io_statistics_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3 << 20, 1 << 20), (2, 1 << 19, 0)], "split_id long, total_bytes long, remote_bytes long")
    for _ in range(2):
        tiles.append_io_statistics(rows, f"{tmp_path}/io")
    got = tiles.read_io_statistics(spark, f"{tmp_path}/io").collect()
    assert Counter((r.split_id, r.total_mb, r.remote_mb) for r in got) == {(1, 3.0, 1.0): 2, (2, 0.5, 0.0): 2} and all(r["at"] for r in got)


def test_index_begins_anew_at_its_first_tile(spark, tmp_path):
    first = spark.createDataFrame([(0, 0, ["a"])], "row int, col int, replicas array<string>")
    later = spark.createDataFrame([(0, 1, ["b"]), (1, 0, ["c"])], first.schema)
    for table in (first, later, first, later):
        tiles.write_grid_index(table, f"{tmp_path}/i", "reset")
    index = tiles.read_grid_index(spark, f"{tmp_path}/i")
    assert Counter((r["row"], r["col"], *r["replicas"]) for r in index.collect()) == Counter([(0, 0, "a"), (0, 1, "b"), (-1, -1, "b"), (1, 0, "c")])
    cells = spark.createDataFrame([(1, 0), (7, 7), (-1, -1), (None, 0)], "row int, col int")
    found = {(r["row"], r["col"]): r["replicas"] for r in placement.look_up_cells(index, cells).collect()}
    assert found == {(1, 0): ["c"], (7, 7): None, (-1, -1): None, (None, 0): None}


def test_pipeline_order_at_the_edges(spark):
    kind = "writer struct<node:string,rack:string>, replicas array<struct<node:string,rack:string>>"
    a, b, c, d = ("a", "/1"), ("b", "/2"), ("c", "/1"), ("d", "/2")
    rows = [(c, [b, d, a]), (None, [b, a, d]), (a, []), (a, None), (d, [a]), (d, [a, b, c, d])]
    df = spark.createDataFrame(rows, kind).withColumn("order", placement.pipeline_order(F.col("writer"), F.col("replicas"))["node"])
    assert [r["order"] for r in df.collect()] == [["a", "d", "b"], ["b", "d", "a"], [], None, ["a"], ["d", "b", "c", "a"]]


def test_checks_of_racks_find_violations(spark):
    placed = spark.createDataFrame([(0, 0, 0, ["a", "c"]), (1, 0, 0, ["a", "b"]), (2, 0, 0, ["a"])], "tx int, ty int, tz int, replicas array<string>")
    nodes = spark.createDataFrame([("a", "/1"), ("b", "/2"), ("c", "/1")], "node string, rack string")
    assert {r.tx for r in audit.rack_violations(placed, nodes).collect()} == {0, 2}
    assert {r.tx: r.ok for r in audit.placement_status(placed, nodes).collect()} == {0: False, 1: True, 2: True}
