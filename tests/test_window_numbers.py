"""Window numbers stay distinct however many main windows there are, in all three places that make them."""

from pyspark.sql import functions as F

from voxelgrid.functions.geometry import GridMeta, GroupSpec, coordinates
from voxelgrid.operators.halo import group_halo
from voxelgrid.operators.windows import group_windows
from voxelgrid.sources.window_source import boxes

# 251 * 200 * 3 main and 199 * 3 seam windows
META, RADIUS, SPEC = GridMeta(252 * 3, 400 * 3, 6 * 3, 3, 3, 3), 1, GroupSpec()


def test_distinct_numbers(spark):
    gx, gy, gz = SPEC.counts(META)
    total = gx * gy * gz + (gy - 1) * gz
    assert total > 150_000
    table = group_windows(spark, META, RADIUS)
    assert table.count() == table.select("split_id").distinct().count() == total
    made = boxes(META, RADIUS, SPEC)
    assert len({n for n, _ in made}) == len(made) == total
    box = {r.split_id: (r.x0, r.x1, r.y0, r.y1, r.z0, r.z1) for r in table.where("kind = 'OR' or gx = 0").collect()}
    assert all(box[n] == b for n, b in made if n in box)
    # voxels at a seam far above the old base: their windows are those of the table
    rows = spark.range(META.x).select(F.col("id").cast("int").alias("x"), F.lit(1195).alias("y"), F.lit(17).alias("z"))
    met = {r.split_id for r in group_halo(rows, META, RADIUS).select("split_id").distinct().collect()}
    want = {r.split_id for r in table.where("y0 <= 1195 and 1195 < y1 and z0 <= 17 and 17 < z1").select("split_id").collect()}
    assert met == want and len(want) > 200


def test_old_base_stays_where_it_is_free():
    assert SPEC.seam_base(GridMeta(20, 30, 40, 5, 5, 10)) == 100_000


def test_coordinates_of_large_indices(spark):
    x, y = 3_000_017, 2_000_003
    at = [(7, 11, 1200), (x - 1, y - 1, 1499), (0, 0, 1000)]
    rows = spark.createDataFrame([(a + b * x + c * x * y,) for a, b, c in at], "i long")
    assert [tuple(r) for r in rows.select(*coordinates(F.col("i"), x, y)).collect()] == at
