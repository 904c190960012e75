"""All registered queries of the raster engine, with DuckDB SQL where it can express them.

The table ``events`` is read as a 3D raster of 20 x 25 x n voxels in tiles of 5 x 5 x 5, the
vectors of ``embeddings`` as a 2D raster with a row per vector in tiles of 50 x 16.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import profiles as P
from .operators import algebra, audit, halo, windows
from .plans import placement
from .sources import generate, tiles

SYNTHETIC = G.GridMeta(24, 32, 32, 8, 8, 8, "synthetic")
NODES = [placement.Node(f"n{k:02d}", "/r1" if k < 7 else "/r2") for k in range(19)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- the driver's tables as rasters

EVENTS = """ev AS (SELECT event_id, (event_id % 20)::INTEGER AS x, (event_id // 20 % 25)::INTEGER AS y, (event_id // 500)::INTEGER AS z,
  floor(value)::BIGINT % 128 AS attr1, value FROM events),
dims AS (SELECT (max(event_id) // 500 + 1)::INTEGER AS zdim, ((max(event_id) // 500 + 5) // 5)::INTEGER AS nz FROM events)"""
PIXELS = """px AS (SELECT vec_id::INTEGER AS y, (i - 1)::INTEGER AS x, 0 AS z, floor(embedding[i]::DOUBLE * 1000)::BIGINT AS value
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
pdims AS (SELECT (max(vec_id) + 1)::INTEGER AS ydim, ((max(vec_id) + 50) // 50)::INTEGER AS ny FROM embeddings)"""


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.GridMeta]:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    depth = table.agg(F.max("event_id")).first()[0] // 500 + 1
    x, y, z = G.coordinates(F.col("event_id"), 20, 25)
    rows = table.select(x.alias("x"), y.alias("y"), z.alias("z"), (F.floor("value") % 128).cast("smallint").alias("attr1"), "event_id", "value")
    return rows, G.GridMeta(20, 25, depth, 5, 5, 5, "events")


def _pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.GridMeta]:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.agg(F.max("vec_id")).first()[0] + 1
    cells = table.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    value = F.floor(F.col("v").cast("double") * 1000).cast("long")
    return cells.select("x", "y", F.lit(0).alias("z"), value.alias("value")), G.GridMeta(64, rows, 1, 16, 50, 1, "embeddings")


# ---- generators

_SYNTHETIC = "id % 24 AS x, id // 24 % 32 AS y, id // 768 AS z"


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines agree on types."""
    return df.select(*(F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes))


@_query(f"SELECT {_SYNTHETIC}, id % 128 AS attr1 FROM range(24576) t(id)")
def gen_simple(spark, sf_dir):
    return _wide(generate.simple(spark, SYNTHETIC))


@_query(f"SELECT {_SYNTHETIC}, id % 128 AS attr1, " + ", ".join(f"10::BIGINT AS attr{k}" for k in range(2, 11)) + " FROM range(24576) t(id)")
def gen_normal(spark, sf_dir):
    return _wide(generate.normal(spark, SYNTHETIC))


@_query(f"SELECT {_SYNTHETIC}, id % 128 AS stratum, id % 128 AS lithology, round((id % 128)::DOUBLE / 3, 3) AS moisture, (id % 128)::DOUBLE / 4 AS hazard, round((id % 128)::DOUBLE / 5, 3) AS uncertainty FROM range(24576) t(id)")
def gen_geology(spark, sf_dir):
    df = generate.geology(spark, SYNTHETIC)
    return _wide(df.withColumns({n: F.round(F.col(n).cast("double"), 3) for n in ("moisture", "hazard", "uncertainty")}))


@_query("SELECT id // 64 AS row, id % 64 AS col, id AS value FROM range(4096) t(id)")
def gen_pixel2d(spark, sf_dir):
    return _wide(generate.pixels(spark, 64, 64))


@_query("SELECT event_id, event_id % 20 AS x, event_id // 20 % 25 AS y, event_id // 500 AS z FROM events")
def voxel_coords(spark, sf_dir):
    return _wide(_events(spark, sf_dir)[0].select("event_id", "x", "y", "z"))


@_query("SELECT event_id, event_id AS idx FROM events")
def linear_index(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return df.select("event_id", halo.index_of(meta).alias("idx"))


@_query(f"WITH {EVENTS} SELECT x // 5 AS tx, y // 5 AS ty, z // 5 AS tz, count(*) AS n FROM ev GROUP BY ALL")
def tile_of_voxel(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return tiles.with_tiles(df, meta).groupBy("tx", "ty", "tz").agg(F.count("*").alias("n"))


# ---- names

_NAMES = """CASE c_custkey % 6 WHEN 0 THEN 'r3d_m' || c_custkey || '_1_2_3' WHEN 1 THEN 'grid_m' || c_custkey || '_4_5' WHEN 2 THEN 'r3dsg_s' || c_custkey || '_7_8_9'
  WHEN 3 THEN 'r3d_info_8_12_4_200_100_50_m' || c_custkey WHEN 4 THEN 'default_d' || c_custkey || '_0_1_0' ELSE 'notes' || c_custkey || '.txt' END"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(_NAMES).alias("name"))


@_query(f"""WITH n AS (SELECT {_NAMES} AS name FROM customer), p AS (SELECT name, string_split(name, '_') AS p FROM n)
SELECT name, CASE WHEN len(p) = 4 AND p[1] = 'grid' OR len(p) = 5 THEN p[1] END AS kind, CASE WHEN len(p) IN (4, 5) THEN p[2] END AS raster,
  CASE len(p) WHEN 4 THEN p[4]::INTEGER WHEN 5 THEN p[3]::INTEGER END AS x, CASE len(p) WHEN 4 THEN p[3]::INTEGER WHEN 5 THEN p[4]::INTEGER END AS y,
  CASE len(p) WHEN 4 THEN 0 WHEN 5 THEN p[5]::INTEGER END AS z FROM p""")
def parse_tile_name(spark, sf_dir):
    t = G.parse_tile_name(F.col("name"))
    return _names(spark, sf_dir).select("name", *(t[c].alias(c) for c in ("kind", "raster", "x", "y", "z")))


@_query(f"""WITH n AS (SELECT {_NAMES} AS name FROM customer), p AS (SELECT name, string_split(name, '_') AS p FROM n WHERE name LIKE 'r3d_info%')
SELECT name, p[1] AS prefix, p[3]::INTEGER AS nx, p[4]::INTEGER AS ny, p[5]::INTEGER AS nz, p[6]::INTEGER AS cx, p[7]::INTEGER AS cy, p[8]::INTEGER AS cz, p[9] AS raster FROM p""")
def parse_info_name(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("m", G.parse_info_name(F.col("name"))).where("m is not null")
    return rows.select("name", "m.*")


@_query(f"""WITH n AS (SELECT {_NAMES} AS name FROM customer) SELECT name, CASE WHEN name LIKE 'r3d\\_info%' ESCAPE '\\' THEN 'marker' WHEN name LIKE 'r3dsg%' THEN 'static'
  WHEN name LIKE 'r3d\\_%' ESCAPE '\\' OR name LIKE 'grid%' THEN 'tile' ELSE 'ordinary' END AS class FROM n""")
def classify_name(spark, sf_dir):
    return _names(spark, sf_dir).select("name", G.classify_name(F.col("name")).alias("class"))


# ---- groups and windows

_TILES = "tiles AS (SELECT (id % 4)::INTEGER AS tx, (id // 4 % 5)::INTEGER AS ty, (id // 20)::INTEGER AS tz FROM range((SELECT nz * 20 FROM dims)) t(id))"


@_query(f"WITH {EVENTS}, {_TILES} SELECT tx, ty, tz, CASE WHEN tx < 2 THEN 0 ELSE 1 + (tx - 2) END::INTEGER AS gx, (ty // 2)::INTEGER AS gy, (tz // 2)::INTEGER AS gz FROM tiles")
def group_of_tile(spark, sf_dir):
    _, meta = _events(spark, sf_dir)
    g = G.main_group(G.GroupSpec(), F.col("tx"), F.col("ty"), F.col("tz"))
    return placement.tiles_of(spark, meta).select("tx", "ty", "tz", *(c.alias(n) for n, c in zip(("gx", "gy", "gz"), g, strict=True)))


@_query(f"WITH {EVENTS}, {_TILES} SELECT tx, ty, tz, CASE WHEN tx <> 0 AND tx <> 3 THEN CASE WHEN tx < 2 THEN 1 ELSE tx END END::INTEGER AS px FROM tiles")
def oc_partner(spark, sf_dir):
    _, meta = _events(spark, sf_dir)
    p = G.right_partner(meta, G.GroupSpec(), F.col("tx"), F.col("ty"), F.col("tz"))
    return placement.tiles_of(spark, meta).select("tx", "ty", "tz", p["x"].alias("px"))


@_query(f"WITH {EVENTS}, {_TILES} SELECT tx, ty, tz, CASE WHEN ty % 2 = 0 AND ty // 2 <> 0 THEN ty // 2 - 1 WHEN ty % 2 = 1 AND ty <> 4 THEN ty // 2 END::INTEGER AS py FROM tiles")
def or_partner(spark, sf_dir):
    _, meta = _events(spark, sf_dir)
    p = G.row_partners(meta, G.GroupSpec(), F.col("tx"), F.col("ty"), F.col("tz"))
    return placement.tiles_of(spark, meta).select("tx", "ty", "tz", F.get(p, F.lit(0))["y"].alias("py"))


GROUP_WINDOWS = f"""{EVENTS}, gz AS (SELECT unnest(range((SELECT (nz + 1) // 2 FROM dims))) AS gz),
gw AS (
  SELECT gx + gy * 3 + gz * 9 AS split_id, 'MG' AS kind, CASE WHEN gx = 0 THEN 0 ELSE gx * 5 + 1 END AS x0, gx * 5 + 10 AS x1, gy * 10 AS y0, least(gy * 10 + 10, 25) AS y1,
    greatest(0, gz * 10 - 2) AS z0, least(gz * 10 + 12, zdim) AS z1, gz FROM range(3) a(gx), range(3) b(gy), gz, dims
  UNION ALL
  SELECT 100000 + gz * 2 + gy, 'OR', 0, 20, gy * 10 + 6, gy * 10 + 14, greatest(0, gz * 10 - 2), least(gz * 10 + 12, zdim), gz FROM range(2) b(gy), gz, dims)"""
TILE_WINDOWS = f"""{EVENTS}, tw AS (SELECT a.t + b.t * 4 + c.t * 20 AS split_id, 'TILE' AS kind, greatest(0, a.t * 5 - 2) AS x0, least(a.t * 5 + 7, 20) AS x1, greatest(0, b.t * 5 - 2) AS y0, least(b.t * 5 + 7, 25) AS y1,
  greatest(0, c.t * 5 - 2) AS z0, least(c.t * 5 + 7, zdim) AS z1 FROM range(4) a(t), range(5) b(t), (SELECT unnest(range((SELECT nz FROM dims))) AS t) c, dims)"""
_ROWS = "(SELECT unnest(range((SELECT ny FROM pdims))) AS t)"
GROUP2D_WINDOWS = f"""{PIXELS}, gy AS (SELECT unnest(range((SELECT (ny + 1) // 2 FROM pdims))) AS gy),
gw AS (
  SELECT gx + gy * 3 AS split_id, 'MG' AS kind, CASE WHEN gx = 0 THEN 0 ELSE gx * 16 + 8 END AS x0, least(gx * 16 + 32, 64) AS x1, gy * 100 AS y0, least(gy * 100 + 100, ydim) AS y1, 0 AS z0, 1 AS z1 FROM range(3) a(gx), gy, pdims
  UNION ALL
  SELECT 100000 + gy, 'OR', 0, 64, gy * 100 + 92, least(gy * 100 + 108, ydim), 0, 1 FROM gy, pdims WHERE gy < (ny + 1) // 2 - 1)"""
ORDINARY_WINDOWS = f"""{PIXELS}, ow AS (SELECT a.t + b.t * 4 AS split_id, 'TILE' AS kind, a.t * 16 AS x0, least(a.t * 16 + 24, 64) AS x1, b.t * 50 AS y0, least(b.t * 50 + 58, ydim) AS y1, 0 AS z0, 1 AS z1 FROM range(4) a(t), {_ROWS} b, pdims)"""
QUADRANT_WINDOWS = f"""{PIXELS}, qw AS (SELECT a.t + b.t * 4 AS split_id, 'QUAD' AS kind, CASE WHEN a.t = 0 THEN 0 ELSE a.t * 16 + 4 END AS x0, CASE WHEN a.t = 2 THEN 64 ELSE a.t * 16 + 28 END AS x1,
  CASE WHEN b.t = 0 THEN 0 ELSE b.t * 50 + 21 END AS y0, CASE WHEN b.t = ny - 2 THEN ydim ELSE b.t * 50 + 79 END AS y1, 0 AS z0, 1 AS z1 FROM range(3) a(t), {_ROWS} b, pdims WHERE b.t < ny - 1)"""
_BOX = "split_id::BIGINT AS split_id, kind, x0::INTEGER AS x0, x1::INTEGER AS x1, y0::INTEGER AS y0, y1::INTEGER AS y1, z0::INTEGER AS z0, z1::INTEGER AS z1"


def _boxes(df: DataFrame) -> DataFrame:
    return df.select("split_id", "kind", *windows.BOX)


@_query(f"WITH {GROUP_WINDOWS} SELECT {_BOX} FROM gw")
def group_windows(spark, sf_dir):
    return _boxes(windows.group_windows(spark, _events(spark, sf_dir)[1], 2))


@_query(f"WITH {TILE_WINDOWS} SELECT {_BOX} FROM tw")
def tile_windows(spark, sf_dir):
    return _boxes(windows.tile_windows(spark, _events(spark, sf_dir)[1], 2))


@_query(f"WITH {GROUP2D_WINDOWS} SELECT {_BOX} FROM gw")
def group2d_windows(spark, sf_dir):
    return _boxes(windows.group_windows(spark, _pixels(spark, sf_dir)[1], 4, halo_z=False))


@_query(f"WITH {ORDINARY_WINDOWS} SELECT {_BOX} FROM ow")
def ordinary2d_windows(spark, sf_dir):
    return _boxes(windows.ordinary2d_windows(spark, _pixels(spark, sf_dir)[1], 4))


@_query(f"WITH {QUADRANT_WINDOWS} SELECT {_BOX} FROM qw")
def quadrant2d_windows(spark, sf_dir):
    return _boxes(windows.quadrant2d_windows(spark, _pixels(spark, sf_dir)[1], 4))


_TOUCH = "x0 < tx * 5 + 5 AND x1 > tx * 5 AND y0 < ty * 5 + 5 AND y1 > ty * 5 AND z0 < tz * 5 + 5 AND z1 > tz * 5"


@_query(f"WITH {GROUP_WINDOWS}, {_TILES} SELECT split_id::BIGINT AS split_id, count(*) AS n, string_agg(tx || '-' || ty || '-' || tz, ' ' ORDER BY tx, ty, tz) AS files FROM gw JOIN tiles ON {_TOUCH} GROUP BY split_id")
def window_tiles(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return _listed(windows.window_tiles(windows.group_windows(spark, meta, 2), meta))


def _listed(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("tx", "ty", "tz")))
    names = F.transform(ordered, lambda t: F.concat_ws("-", t["tx"].cast("string"), t["ty"].cast("string"), t["tz"].cast("string")))
    return rows.groupBy("split_id").agg(F.count("*").alias("n"), F.array_join(names, " ").alias("files"))


@_query(f"WITH {GROUP_WINDOWS}, {_TILES} SELECT split_id::BIGINT AS split_id, count(*) AS n, string_agg(tx || '-' || ty || '-' || tz, ' ' ORDER BY tx, ty, tz) AS files FROM gw JOIN tiles ON {_TOUCH} AND tz // 2 = gz GROUP BY split_id")
def window_main_tiles(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return _listed(windows.main_tiles(windows.group_windows(spark, meta, 2), meta))


@_query(f"WITH {EVENTS}, {_TILES} SELECT a.tx, a.ty, a.tz, count(*) AS n FROM tiles a JOIN tiles b ON abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 AND abs(a.tz - b.tz) <= 1 GROUP BY ALL")
def tile_neighbourhood(spark, sf_dir):
    return windows.tile_neighbourhood(spark, _events(spark, sf_dir)[1]).groupBy("tx", "ty", "tz").agg(F.count("*").alias("n"))


# ---- assembly

_IN = "x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1"


def _digest(df: DataFrame, value: str) -> DataFrame:
    place = F.col("dx") + 31 * F.col("dy") + 977 * F.col("dz")
    return df.groupBy("split_id").agg(F.count("*").alias("n"), F.sum(value).cast("long").alias("total"), F.min(value).cast("long").alias("least"), F.max(value).cast("long").alias("most"), F.sum(F.col(value).cast("long") * place).alias("placed"))


def _digest_sql(value: str, source: str, boxes: str) -> str:
    return f"""SELECT split_id::BIGINT AS split_id, count(*) AS n, sum({value})::BIGINT AS total, min({value})::BIGINT AS least, max({value})::BIGINT AS most,
  sum({value} * ((x - x0) + 31 * (y - y0) + 977 * (z - z0)))::BIGINT AS placed FROM {source} JOIN {boxes} ON {_IN} GROUP BY split_id"""


@_query(f"WITH {GROUP_WINDOWS} " + _digest_sql("attr1", "ev", "gw"))
def halo_group(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return _digest(halo.group_halo(df.select("x", "y", "z", "attr1"), meta, 2), "attr1")


@_query(f"WITH {TILE_WINDOWS} " + _digest_sql("attr1", "ev", "tw"))
def halo_tile(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return _digest(halo.tile_halo(df.select("x", "y", "z", "attr1"), meta, 2), "attr1")


@_query(f"WITH {GROUP2D_WINDOWS} " + _digest_sql("value", "px", "gw"))
def halo_group2d(spark, sf_dir):
    df, meta = _pixels(spark, sf_dir)
    return _digest(halo.group_halo(df, meta, 4, halo_z=False), "value")


@_query(f"WITH {ORDINARY_WINDOWS} " + _digest_sql("value", "px", "ow"))
def halo_ordinary2d(spark, sf_dir):
    df, meta = _pixels(spark, sf_dir)
    return _digest(halo.ordinary2d_halo(df, meta, 4), "value")


@_query(f"WITH {QUADRANT_WINDOWS} " + _digest_sql("value", "px", "qw"))
def halo_quadrant2d(spark, sf_dir):
    df, meta = _pixels(spark, sf_dir)
    return _digest(halo.quadrant2d_halo(df, meta, 4), "value")


@_query(f"WITH {GROUP_WINDOWS} SELECT split_id::BIGINT AS split_id, count(*)::INTEGER AS n, md5(string_agg(attr1::VARCHAR, ',' ORDER BY z, y, x)) AS digest FROM ev JOIN gw ON {_IN} GROUP BY split_id")
def window_block(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    rows = halo.blocks(halo.group_halo(df.select("x", "y", "z", "attr1"), meta, 2), ["attr1"])
    return rows.select("split_id", F.size("attr1").alias("n"), F.md5(F.array_join(F.transform("attr1", lambda v: v.cast("string")), ",")).alias("digest"))


@_query(f"""WITH {EVENTS}, o AS (SELECT unnest(range(-1, 2)) AS d)
SELECT a.x, a.y, a.z, sum(b.attr1)::BIGINT AS total, count(*) AS n FROM ev a, o ox, o oy, o oz JOIN ev b ON b.event_id = a.event_id + ox.d + 20 * oy.d + 500 * oz.d
WHERE a.x + ox.d BETWEEN 0 AND 19 AND a.y + oy.d BETWEEN 0 AND 24 GROUP BY ALL""")
def stencil_mean_group(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return halo.stencil_mean(df, meta, 1, "attr1")


# ---- resampling and slicing


def _blocks_sql(side: int, z: str = "zdim") -> str:
    return f"WHERE x < 20 // {side} * {side} AND y < 25 // {side} * {side} AND z < {z} // {side} * {side} GROUP BY ALL"


@_query(f"WITH {EVENTS} SELECT (x // 2)::INTEGER AS bx, (y // 2)::INTEGER AS by, (z // 2)::INTEGER AS bz, (sum(attr1)::BIGINT // 8 % 128) AS attr1 FROM ev, dims {_blocks_sql(2)}")
def block_average_r1(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return algebra.block_average(df, meta, 1, ["attr1"])


@_query(f"WITH {EVENTS} SELECT (x // 4)::INTEGER AS bx, (y // 4)::INTEGER AS by, (z // 4)::INTEGER AS bz, (sum(attr1)::BIGINT // 64 % 128) AS attr1 FROM ev, dims {_blocks_sql(4)}")
def block_average(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return algebra.block_average(df, meta, 2, ["attr1"])


_TEN = "attr1, " + ", ".join(f"(attr1 * {k} + event_id) % 128 AS attr{k}" for k in range(2, 11))
_TEN_MEANS = ", ".join(f"(sum(attr{k})::BIGINT // 64 % 128) AS attr{k}" for k in range(1, 11))


@_query(f"WITH {EVENTS}, ten AS (SELECT x, y, z, {_TEN} FROM ev) SELECT (x // 4)::INTEGER AS bx, (y // 4)::INTEGER AS by, (z // 4)::INTEGER AS bz, {_TEN_MEANS} FROM ten, dims {_blocks_sql(4)}")
def block_average_multi(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    ten = df.withColumns({f"attr{k}": (F.col("attr1").cast("long") * k + F.col("event_id")) % 128 for k in range(2, 11)})
    return algebra.block_average(ten, meta, 2, [f"attr{k}" for k in range(1, 11)])


@_query(f"WITH {EVENTS} SELECT (x // 4)::INTEGER AS bx, (y // 4)::INTEGER AS by, (z // 4)::INTEGER AS bz, round(avg(value / 3), 6) AS moisture, round(avg(value / 4), 6) AS hazard FROM ev, dims {_blocks_sql(4)}")
def block_average_geology_exact(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    two = df.withColumns({"moisture": F.col("value") / 3, "hazard": F.col("value") / 4})
    return algebra.block_average(two, meta, 2, ["moisture", "hazard"], mode="exact").withColumns({n: F.round(n, 6) for n in ("moisture", "hazard")})


@_query(f"WITH {EVENTS} SELECT (x // 4)::INTEGER AS bx, (y // 4)::INTEGER AS by, (z // 4)::INTEGER AS bz, (sum(floor(value / 3)::BIGINT)::BIGINT // 64 % 128) AS moisture FROM ev, dims {_blocks_sql(4)}")
def block_average_geology_legacy(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return algebra.block_average(df.withColumn("moisture", F.col("value") / 3), meta, 2, ["moisture"], mode="legacy")


@_query(f"""WITH {EVENTS}, s AS (SELECT x, y, z, attr1, unnest([z // 2, z // 2 - 1]) AS layer FROM ev)
SELECT (x // 4)::INTEGER AS bx, (y // 4)::INTEGER AS by, layer::INTEGER AS layer, (sum(attr1)::BIGINT // 64 % 128) AS attr1 FROM s, dims WHERE layer >= 0 AND layer * 2 + 4 <= zdim AND x < 20 AND y < 24 GROUP BY ALL""")
def sliding_z_average(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return algebra.sliding_z_average(df, meta, 2, ["attr1"])


@_query(f"WITH {EVENTS} SELECT (x - 3)::INTEGER AS x, (y - 4)::INTEGER AS y, (z - 1)::INTEGER AS z, attr1 FROM ev WHERE x >= 3 AND x < 11 AND y >= 4 AND y < 20 AND z >= 1 AND z < 9")
def box_slice(spark, sf_dir):
    return _long1(algebra.box_slice(_events(spark, sf_dir)[0], (3, 11), (4, 20), (1, 9)))


def _long1(df: DataFrame) -> DataFrame:
    return df.select("x", "y", "z", F.col("attr1").cast("long").alias("attr1"))


@_query(f"WITH {EVENTS} SELECT x, y, (z - 2)::INTEGER AS z, attr1 FROM ev WHERE z >= 2 AND z < 7")
def z_region(spark, sf_dir):
    return _long1(algebra.z_region(_events(spark, sf_dir)[0], 2, 7))


@_query(f"WITH {EVENTS} SELECT x, y, (z - 1)::INTEGER AS z, attr1 FROM ev WHERE z >= 1 UNION ALL SELECT x, y, z, attr1 FROM ev, dims WHERE z >= zdim - 1")
def slab_shift(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return _long1(algebra.slab_shift(df, meta, 1))


@_query(f"WITH {EVENTS} SELECT x, y, z, attr1 FROM ev UNION ALL SELECT x, y, (z + zdim)::INTEGER AS z, attr1 FROM ev, dims WHERE z < 1")
def z_merge(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return _long1(algebra.z_merge([(df, meta.z), (algebra.z_region(df, 0, 1), 1)]))


@_query(f"WITH {EVENTS} SELECT x, y, z, attr1 FROM ev WHERE x = 7 AND y = 11 AND z = 1")
def point_read(spark, sf_dir):
    return _long1(algebra.point_read(_events(spark, sf_dir)[0], 7, 11, 1))


@_query(f"WITH {EVENTS} SELECT x, y, z, CASE WHEN event_id = 777 THEN 99 ELSE attr1 END AS attr1 FROM ev")
def point_write(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    return _long1(algebra.point_write(df, meta, 777, {"attr1": 99}))


@_query(f"WITH {EVENTS} SELECT x, y, z, attr1 FROM ev")
def attr_project(spark, sf_dir):
    return _long1(algebra.attributes(_events(spark, sf_dir)[0], ["attr1"]))


# ---- placement and audit

_PLACED = f"""{_TILES}, placed AS (SELECT tx, ty, tz, k, (tx + 2 * ty + 3 * tz + 7 * k) % 19 AS node FROM tiles, range(3) r(k))"""


def _placement(spark: SparkSession, meta: G.GridMeta) -> DataFrame:
    node = lambda k: F.format_string("n%02d", ((F.col("tx") + 2 * F.col("ty") + 3 * F.col("tz") + 7 * k) % 19).cast("int"))
    return placement.tiles_of(spark, meta).withColumn("replicas", F.array(*(node(k) for k in range(3))))


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n.name, n.rack, 100 + 7 * k, 50 + 13 * k % 97, float(k * 5 % 23), "normal" if k % 6 else "decommissioned") for k, n in enumerate(NODES)], "node string, rack string, capacity long, remaining long, load double, state string")


@_query(f"WITH {EVENTS}, {_PLACED} SELECT printf('n%02d', node) AS node, count(*) AS replicas FROM placed GROUP BY ALL")
def replicas_per_node(spark, sf_dir):
    return audit.replicas_per_node(_placement(spark, _events(spark, sf_dir)[1]))


@_query(f"WITH {EVENTS}, {_PLACED} SELECT tx, ty, tz FROM placed GROUP BY ALL HAVING count(DISTINCT node < 7) = 1")
def rack_violations(spark, sf_dir):
    return audit.rack_violations(_placement(spark, _events(spark, sf_dir)[1]), _nodes(spark))


@_query(f"WITH {EVENTS}, {_PLACED} SELECT tx, ty, tz, count(*) AS replicas, count(DISTINCT node < 7) AS racks, count(DISTINCT node < 7) >= 2 AS ok FROM placed GROUP BY ALL")
def placement_status(spark, sf_dir):
    return audit.placement_status(_placement(spark, _events(spark, sf_dir)[1]), _nodes(spark))


_HOSTS = f"""mt AS (SELECT split_id, tx, ty, tz FROM gw JOIN tiles ON {_TOUCH} AND tz // 2 = gz), total AS (SELECT split_id, count(*) AS tiles FROM mt GROUP BY 1),
hc AS (SELECT split_id, printf('n%02d', node) AS host, count(*) AS n FROM mt JOIN placed USING (tx, ty, tz) GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY n DESC, host) AS rank, max(n) OVER (PARTITION BY split_id) AS best FROM hc JOIN total USING (split_id))"""


@_query(f"WITH {GROUP_WINDOWS}, {_PLACED}, {_HOSTS} SELECT split_id::BIGINT AS split_id, rank::INTEGER AS rank, host, n FROM hr WHERE (best = tiles AND n = tiles) OR (best < tiles AND rank <= 3)")
def preferred_hosts_group(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return audit.preferred_hosts(windows.main_tiles(windows.group_windows(spark, meta, 2), meta), _placement(spark, meta))


@_query(f"""WITH {EVENTS}, {_PLACED}, c AS (SELECT a.tx, a.ty, a.tz, a.node, count(*) AS n FROM placed a JOIN placed b ON a.node = b.node AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 AND abs(a.tz - b.tz) <= 1 GROUP BY ALL)
SELECT tx, ty, tz, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY n DESC, node)::INTEGER AS rank, printf('n%02d', node) AS host, n FROM c""")
def preferred_hosts_tile(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return audit.preferred_hosts_of_tile(windows.tile_neighbourhood(spark, meta), _placement(spark, meta))


@_query(f"""WITH {GROUP_WINDOWS}, {_PLACED}, {_HOSTS}, parts AS (SELECT split_id, tx, ty, tz,
  (least(x1, tx * 5 + 5) - greatest(x0, tx * 5)) * (least(y1, ty * 5 + 5) - greatest(y0, ty * 5)) * (least(z1, tz * 5 + 5, zdim) - greatest(z0, tz * 5)) * 14 AS bytes FROM dims, gw JOIN tiles ON {_TOUCH}),
first AS (SELECT split_id, host FROM hr WHERE rank = 1)
SELECT split_id::BIGINT AS split_id, sum(bytes)::BIGINT AS total_bytes, sum(CASE WHEN EXISTS (SELECT 1 FROM placed p WHERE p.tx = parts.tx AND p.ty = parts.ty AND p.tz = parts.tz AND printf('n%02d', p.node) = host) THEN 0 ELSE bytes END)::BIGINT AS remote_bytes
FROM parts JOIN first USING (split_id) GROUP BY split_id""")
def io_theory(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    w, placed = windows.group_windows(spark, meta, 2), _placement(spark, meta)
    hosts = audit.preferred_hosts(windows.main_tiles(w, meta), placed)
    return audit.io_theory(w, meta, P.GEOLOGY.voxel_bytes, placed, hosts)


@_query(f"WITH {GROUP_WINDOWS} SELECT count(*) AS windows, sum((x1 - x0) * (y1 - y0) * (z1 - z0))::BIGINT AS delivered, sum((x1 - x0) * (y1 - y0) * (z1 - z0))::DOUBLE / (500 * (SELECT zdim FROM dims)) AS amplification FROM gw")
def read_amplification(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return audit.read_amplification(windows.group_windows(spark, meta, 2), meta)


@_query("""SELECT 'r3dsg_s_' || s_suppkey || '_0_0' AS file, printf('n%02d', s_suppkey % 19) AS first_node FROM supplier WHERE s_suppkey % 3 = 0""")
def static_placement(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    file = F.concat(F.lit("r3dsg_s_"), F.col("s_suppkey").cast("string"), F.lit("_0_0"))
    node = lambda k: F.format_string("n%02d", ((F.col("s_suppkey") + k) % 19).cast("int"))
    table = suppliers.where("s_suppkey % 3 = 0").select(file.alias("file"), F.array(*(node(k) for k in range(3))).alias("replicas"))
    return placement.static_placement(suppliers.select(file.alias("file")), table).select("file", F.col("replicas")[0].alias("first_node"))


@_query(f"""WITH {EVENTS}, {_TILES}, g AS (SELECT *, CASE WHEN tx < 2 THEN 0 ELSE tx - 1 END AS gx, ty // 2 AS gy, tz // 2 AS gz,
  CASE WHEN tx IN (1, 2) THEN CASE WHEN tx < 2 THEN 1 ELSE tx END END AS px, CASE WHEN ty % 2 = 0 AND ty // 2 <> 0 THEN ty // 2 - 1 WHEN ty % 2 = 1 AND ty <> 4 THEN ty // 2 END AS py FROM tiles)
SELECT tx, ty, tz, 'MG' || gx || gy || gz AS mg_node, 'OR0' || py || gz AS or_node, 'MG' || px || gy || gz AS oc_node FROM g""")
def table_lookup(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    w = windows.group_windows(spark, meta, 2)
    groups = w.select("kind", "gx", "gy", "gz", F.concat("kind", *(F.col(c).cast("string") for c in ("gx", "gy", "gz"))).alias("value"))
    return placement.look_up_groups(placement.tiles_of(spark, meta), groups, meta)


@_query("WITH m AS (SELECT printf('n%02d', c_custkey % 11) AS node FROM customer WHERE c_custkey % 5 = 0) SELECT printf('n%02d', k) AS node, (SELECT count(*) FROM m WHERE m.node = printf('n%02d', k)) AS n FROM range(19) t(k)")
def marker_balance(spark, sf_dir):
    index = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(0).alias("row"), F.array(F.format_string("n%02d", (F.col("c_custkey") % 11).cast("int"))).alias("replicas"))
    return audit.marker_balance(index, _nodes(spark))


@_query("""WITH n AS (SELECT printf('n%02d', k) AS node, 50 + 13 * k % 97 AS remaining, (k * 5 % 23)::DOUBLE AS load, k % 6 <> 0 AS normal FROM range(19) t(k))
SELECT node, normal AND remaining >= 80 AND load <= 2 * (SELECT avg(load) FROM n WHERE normal) AS good FROM n""")
def good_target(spark, sf_dir):
    return audit.good_target(_nodes(spark), 80).select("node", "good")


@_query("""WITH n AS (SELECT printf('n%02d', k) AS node, 50 + 13 * k % 97 AS remaining, (k * 5 % 23)::DOUBLE AS load, k % 6 <> 0 AS normal, k % 3 AS scheduled, k * 7 % 19 AS heartbeat, k % 4 <> 3 AS disk, k < 7 AS r1 FROM range(19) t(k))
SELECT node, normal AND remaining - scheduled * 30 >= 30 AND load <= 2 * (SELECT avg(load) FROM n WHERE normal) AND disk AND heartbeat >= 3 AND NOT r1 AS good FROM n""")
def good_target_in_full(spark, sf_dir):
    k = F.substring("node", 2, 2).cast("int")
    nodes = _nodes(spark).withColumns({"scheduled": k % 3, "heartbeat": k * 7 % 19, "type": F.when(k % 4 == 3, "ARCHIVE").otherwise("DISK")})
    return audit.good_target(nodes, 30, storage_type="DISK", avoid_stale=True, stale_before=3, chosen_racks=("/r1", "/r1", "/r2"), most_per_rack=2).select("node", "good")


@_query(f"WITH {GROUP_WINDOWS}, {_TILES}, w AS (SELECT tx, ty, tz FROM gw JOIN tiles ON {_TOUCH}) SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM w)) AS files, (SELECT count(*) FROM w) AS opens")
def input_file_count(spark, sf_dir):
    meta = _events(spark, sf_dir)[1]
    return audit.input_files(windows.window_tiles(windows.group_windows(spark, meta, 2), meta))


@_query(f"""WITH {EVENTS}, s AS (SELECT unnest(range((SELECT zdim // 2 - 1 FROM dims))) AS layer)
SELECT layer::INTEGER AS layer, count(*) AS n, sum(attr1)::BIGINT AS total, sum(attr1 * (x + 31 * y + 977 * (z - 2 * layer)))::BIGINT AS placed FROM ev JOIN s ON z >= 2 * layer AND z < 2 * layer + 4 GROUP BY layer""")
def sliding_z_slabs(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    place = F.col("x") + 31 * F.col("y") + 977 * F.col("z")
    slabs = algebra.sliding_z_average(df, meta, 2, ["attr1"], resample=False)
    return slabs.groupBy("layer").agg(F.count("*").alias("n"), F.sum("attr1").cast("long").alias("total"), F.sum(F.col("attr1").cast("long") * place).alias("placed"))


@_query("""WITH r AS (SELECT o_orderkey // 3 AS block, printf('n%02d', o_orderkey % 19) AS node, CASE WHEN o_orderkey % 19 < 7 THEN '/r1' ELSE '/r2' END AS rack FROM orders)
SELECT block::BIGINT AS block, node, rack, count(*) OVER (PARTITION BY block, rack) > 1 AS shared FROM r""")
def replicas_by_rack(spark, sf_dir):
    return placement.replicas_by_rack(_replicas(spark, sf_dir).select("block", "node", "rack"))


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rack = F.when(k % 19 < 7, "/r1").otherwise("/r2")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 3").alias("block"), F.format_string("n%02d", (k % 19).cast("int")).alias("node"), rack.alias("rack"), (k % 101).alias("heartbeat"), (k * 7 % 113).alias("remaining"))


@_query("""WITH r AS (SELECT o_orderkey // 3 AS block, printf('n%02d', o_orderkey % 19) AS node, o_orderkey % 101 AS heartbeat, o_orderkey * 7 % 113 AS remaining, CASE WHEN o_orderkey % 19 < 7 THEN '/r1' ELSE '/r2' END AS rack FROM orders),
s AS (SELECT *, count(*) OVER (PARTITION BY block, rack) > 1 AS shared FROM r), t AS (SELECT *, bool_or(shared) OVER (PARTITION BY block) AS any_shared FROM s)
SELECT block::BIGINT AS block, coalesce(arg_min(node, heartbeat * 1000 + substr(node, 2)::INTEGER) FILTER (WHERE heartbeat < 10), arg_min(node, remaining * 1000 + substr(node, 2)::INTEGER)) AS node FROM t WHERE shared OR NOT any_shared GROUP BY block""")
def extra_replica_by_rack(spark, sf_dir):
    return placement.extra_replica(_replicas(spark, sf_dir), 10)


@_query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 19 AS w, o_orderkey * 3 % 19 AS a, (o_orderkey * 3 + 5) % 19 AS b, (o_orderkey * 3 + 11) % 19 AS c FROM orders),
d AS (SELECT *, CASE WHEN w = a THEN 0 WHEN (w < 7) = (a < 7) THEN 2 ELSE 4 END AS da, CASE WHEN w = b THEN 0 WHEN (w < 7) = (b < 7) THEN 2 ELSE 4 END AS db, CASE WHEN w = c THEN 0 WHEN (w < 7) = (c < 7) THEN 2 ELSE 4 END AS dc FROM o),
f AS (SELECT k, CASE WHEN da <= db AND da <= dc THEN a WHEN db <= dc THEN b ELSE c END AS x, CASE WHEN da <= db AND da <= dc THEN b WHEN db <= dc THEN a ELSE b END AS y, CASE WHEN da <= db AND da <= dc THEN c WHEN db <= dc THEN c ELSE a END AS z FROM d)
SELECT k AS block, CASE WHEN (x < 7) <> (y < 7) AND (x < 7) = (z < 7) THEN printf('n%02d n%02d n%02d', x, z, y) ELSE printf('n%02d n%02d n%02d', x, y, z) END AS nodes FROM f""")
def pipeline_order(spark, sf_dir):
    node = lambda n: F.struct(F.format_string("n%02d", n.cast("int")).alias("node"), F.when(n < 7, "/r1").otherwise("/r2").alias("rack"))
    k = F.col("o_orderkey")
    order = placement.pipeline_order(node(k % 19), F.array(*(node((k * 3 + p) % 19) for p in (0, 5, 11))))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("block"), F.array_join(order["node"], " ").alias("nodes"))


@_query("""WITH i AS (SELECT c_custkey // 10 AS row, c_custkey % 10 AS col, printf('n%02d n%02d', c_custkey % 19, (c_custkey + 4) % 19) AS replicas FROM customer WHERE c_custkey % 7 <> 0)
SELECT o_orderkey AS id, r::BIGINT AS row, c::BIGINT AS col, replicas FROM (SELECT o_orderkey, o_custkey // 10 AS r, o_custkey % 10 AS c FROM orders) LEFT JOIN i ON r = row AND c = col""")
def look_up_cells(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.array(*(F.format_string("n%02d", ((k + p) % 19).cast("int")) for p in (0, 4)))
    index = spark.read.parquet(f"{sf_dir}/customer.parquet").where(k % 7 != 0).select(F.expr("c_custkey div 10").alias("row"), (k % 10).alias("col"), names.alias("replicas"))
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.expr("o_custkey div 10").alias("row"), (F.col("o_custkey") % 10).alias("col"))
    return placement.look_up_cells(index, cells).select("id", "row", "col", F.array_join("replicas", " ").alias("replicas"))


@_query("""SELECT n::INTEGER AS n, r::INTEGER AS r, CASE WHEN r <= 1 THEN n WHEN (n - 1) // r + 2 = n THEN (n - 1) // r + 1 ELSE (n - 1) // r + 2 END::INTEGER AS most FROM range(1, 13) a(n), range(1, 7) b(r)""")
def max_nodes_per_rack(spark, sf_dir):
    rows = spark.range(72).select((F.col("id") % 12 + 1).cast("int").alias("n"), (F.floor(F.col("id") / 12) + 1).cast("int").alias("r"))
    return rows.withColumn("most", G.max_nodes_per_rack(F.col("n"), F.col("r")))


@_query("""WITH r AS (SELECT o_orderkey // 3 AS block, printf('n%02d', o_orderkey % 19) AS node, o_orderkey % 101 AS heartbeat, o_orderkey * 7 % 113 AS remaining FROM orders)
SELECT block::BIGINT AS block, coalesce(arg_min(node, heartbeat * 1000 + substr(node, 2)::INTEGER) FILTER (WHERE heartbeat < 10), arg_min(node, remaining * 1000 + substr(node, 2)::INTEGER)) AS node FROM r GROUP BY block""")
def extra_replica(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(k / 3).alias("block"), F.format_string("n%02d", (k % 19).cast("int")).alias("node"), (k % 101).alias("heartbeat"), (k * 7 % 113).alias("remaining"))
    return placement.extra_replica(rows, 10)


@_query()
def plan_group_placement(spark, sf_dir):
    return placement.group_table(spark, _events(spark, sf_dir)[1], NODES)


@_query()
def plan_tile_replicas(spark, sf_dir):
    return placement.plan_tile_replicas(spark, _events(spark, sf_dir)[1], NODES)


@_query()
def plan_column_chain(spark, sf_dir):
    return placement.plan_column_chain(spark, "testfile", 3, 150, NODES, "n00")


# ---- tile bytes


@_query(f"WITH {EVENTS} SELECT x, y, z, attr1 FROM ev")
def tile_roundtrip(spark, sf_dir):
    df, meta = _events(spark, sf_dir)
    packed = tiles.pack(df, meta, P.SIMPLE)
    return _long1(tiles.unpack(packed, meta, P.SIMPLE))


@_query("SELECT id % 24 AS x, id // 24 % 32 AS y, id // 768 AS z, id % 128 AS stratum, id % 128 AS lithology, round((id % 128)::DOUBLE / 3, 3) AS moisture, (id % 128)::DOUBLE / 4 AS hazard, round((id % 128)::DOUBLE / 5, 3) AS uncertainty FROM range(24576) t(id)")
def tile_roundtrip_geology(spark, sf_dir):
    back = tiles.unpack(tiles.pack(generate.geology(spark, SYNTHETIC), SYNTHETIC, P.GEOLOGY), SYNTHETIC, P.GEOLOGY)
    return _wide(back.withColumns({n: F.round(F.col(n).cast("double"), 3) for n in ("moisture", "hazard", "uncertainty")}))


@_query("SELECT id % 24 AS x, id // 24 % 32 AS y, id // 768 AS z, id % 128 AS attr1, " + ", ".join(f"10::BIGINT AS attr{k}" for k in range(2, 11)) + " FROM range(24576) t(id)")
def tile_roundtrip_normal(spark, sf_dir):
    return _wide(tiles.unpack(tiles.pack(generate.normal(spark, SYNTHETIC), SYNTHETIC, P.NORMAL), SYNTHETIC, P.NORMAL))


@_query(f"WITH {PIXELS} SELECT x, y, value FROM px")
def tile_roundtrip_pixel2d(spark, sf_dir):
    df, meta = _pixels(spark, sf_dir)
    back = tiles.unpack(tiles.pack(df, meta, P.PIXEL2D), meta, P.PIXEL2D)
    return back.select("x", "y", F.col("value").cast("long").alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
