"""Locality of windows and checks of placements.

A placement has one row (tx, ty, tz, replicas) per tile. Windows and tiles are few next to
voxels; bytes come from their geometry, so no voxel is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta
from .windows import BOX, window_tiles

TILE = ["tx", "ty", "tz"]


def replicas_per_node(placement: DataFrame) -> DataFrame:
    return placement.select(F.explode("replicas").alias("node")).groupBy("node").agg(F.count("*").alias("replicas"))


def tiles_per_host(tiles: DataFrame, placement: DataFrame) -> DataFrame:
    """(split_id, host, n): tiles of each window that a host has."""
    return tiles.join(placement, TILE).select("split_id", F.explode("replicas").alias("host")).groupBy("split_id", "host").agg(F.count("*").alias("n"))


def preferred_hosts(tiles: DataFrame, placement: DataFrame, most: int = 3) -> DataFrame:
    """(split_id, rank, host, n): hosts of all tiles of a window, or else the few with most; ties by name."""
    counts = tiles_per_host(tiles, placement).join(tiles.groupBy("split_id").agg(F.count("*").alias("tiles")), "split_id")
    order = Window.partitionBy("split_id").orderBy(F.desc("n"), "host")
    best = F.max("n").over(Window.partitionBy("split_id"))
    rows = counts.withColumns({"rank": F.row_number().over(order), "best": best})
    full = F.col("best") == F.col("tiles")
    return rows.where((full & (F.col("n") == F.col("tiles"))) | (~full & (F.col("rank") <= most))).select("split_id", "rank", "host", "n")


def preferred_hosts_of_tile(neighbourhood: DataFrame, placement: DataFrame) -> DataFrame:
    """(tx, ty, tz, rank, host, n): a tile's own hosts by the tiles around it that they have."""
    own = placement.select(*TILE, F.explode("replicas").alias("host"))
    near = placement.select(F.col("tx").alias("nx"), F.col("ty").alias("ny"), F.col("tz").alias("nz"), F.explode("replicas").alias("host"))
    counts = own.join(neighbourhood, TILE).join(near, ["nx", "ny", "nz", "host"]).groupBy(*TILE, "host").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*TILE).orderBy(F.desc("n"), "host")
    return counts.withColumn("rank", F.row_number().over(order)).select(*TILE, "rank", "host", "n")


def _overlap(axis: str, size: int, most: int) -> Column:
    t = F.col(f"t{axis}")
    return (F.least(F.col(f"{axis}1"), (t + 1) * size, F.lit(most)) - F.greatest(F.col(f"{axis}0"), t * size)).cast("long")


def io_theory(windows: DataFrame, meta: GridMeta, voxel_bytes: int, placement: DataFrame, hosts: DataFrame) -> DataFrame:
    """(split_id, total_bytes, remote_bytes): what each window reads, and from other nodes than its first host."""
    parts = window_tiles(windows, meta).join(windows.select("split_id", *BOX), "split_id")
    size = _overlap("x", meta.cx, meta.x) * _overlap("y", meta.cy, meta.y) * _overlap("z", meta.cz, meta.z) * voxel_bytes
    first = hosts.where("rank = 1").select("split_id", "host")
    rows = parts.withColumn("bytes", size).join(placement, TILE).join(first, "split_id", "left")
    remote = F.when(F.array_contains("replicas", F.col("host")), 0).otherwise(F.col("bytes"))
    return rows.groupBy("split_id").agg(F.sum("bytes").alias("total_bytes"), F.sum(remote).alias("remote_bytes"))


def read_amplification(windows: DataFrame, meta: GridMeta) -> DataFrame:
    """(windows, delivered, amplification): voxels of all windows over voxels stored."""
    volume = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return windows.agg(F.count("*").alias("windows"), F.sum(volume).alias("delivered")).withColumn("amplification", F.col("delivered") / F.lit(float(meta.voxels)))


def input_files(tiles: DataFrame) -> DataFrame:
    """(files, opens): tile files that windows read, and how often one is opened."""
    return tiles.groupBy(*TILE).agg(F.count("*").alias("n")).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("opens"))


def placement_status(placement: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(tx, ty, tz, replicas, racks, ok): distinct racks of each tile against the least."""
    rows = placement.select(*TILE, F.explode("replicas").alias("node")).join(nodes.select("node", "rack"), "node", "left")
    racks = rows.groupBy(*TILE).agg(F.count("*").alias("replicas"), F.count_distinct("rack").alias("racks"))
    return racks.withColumn("ok", F.col("racks") >= F.least(F.lit(least), F.col("replicas")))


def rack_violations(placement: DataFrame, nodes: DataFrame) -> DataFrame:
    return placement_status(placement, nodes).where("racks = 1").select(*TILE)


def marker_balance(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n): marker rows per node, 0 where there are none."""
    counts = index.where("row = -1").groupBy(F.col("replicas")[0].alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def good_target(nodes: DataFrame, block_bytes: int, *, storage_type: str | None = None, avoid_stale: bool = False, stale_before: int = 0, consider_load: bool = True, chosen_racks: tuple[str, ...] = (), most_per_rack: int | None = None) -> DataFrame:
    """Adds ``good``: in service, with room for the block, and no more than twice the mean load.

    On request also: of a storage type (column ``type``), with a ``heartbeat`` that is not
    stale, and on a ``rack`` that has fewer than ``most_per_rack`` of the nodes chosen so far.
    Blocks already on their way (column ``scheduled``) take their room first. Nulls are not good.
    """
    mean = nodes.where("state = 'normal'").agg(F.avg("load").alias("mean_load"))
    rows = nodes.join(F.broadcast(mean))  # one row
    taken = F.col("scheduled") * block_bytes if "scheduled" in nodes.columns else F.lit(0)
    good = (F.col("state") == "normal") & (F.col("remaining") - taken >= block_bytes)
    if consider_load:
        good &= F.col("load") <= 2 * F.col("mean_load")
    if storage_type is not None:
        good &= F.col("type") == storage_type
    if avoid_stale:
        good &= F.col("heartbeat") >= stale_before
    if most_per_rack is not None:
        same = sum((F.when(F.col("rack") == r, 1).otherwise(0) for r in chosen_racks), F.lit(0))
        good &= same < most_per_rack
    return rows.withColumn("good", F.coalesce(good, F.lit(False))).drop("mean_load")
