"""Replica placement of tiles as a planner.

Choosing nodes for groups is a greedy sequence over groups, which are few: a raster of a
billion tiles has one group for some hundred millions of voxels. It runs once per raster in a
grouped pandas function; everything per tile is joins. Ties go to the smaller node name.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import GridMeta, GroupSpec, main_group, right_partner, row_partners
from ..operators.windows import _split

REPLICAS = 3


@dataclass(frozen=True)
class Node:
    name: str
    rack: str


class Load:
    """Groups and tiles given to each node so far."""

    def __init__(self, nodes: list[Node]):
        self.nodes = {n.name: n for n in nodes}
        self.groups = dict.fromkeys(self.nodes, 0)
        self.tiles = dict.fromkeys(self.nodes, 0)

    def least(self, excluded: set, allowed=None) -> str | None:
        """The node with fewest groups, then fewest tiles, of those that may be taken."""
        free = [n for n in self.nodes if n not in excluded and (allowed is None or allowed(self.nodes[n]))]
        return min(free, key=lambda n: (self.groups[n], self.tiles[n], n), default=None)

    def give(self, name: str, tiles: int, groups: int = 1) -> str:
        self.groups[name] += groups
        self.tiles[name] += tiles
        return name


def plan_groups(meta: GridMeta, nodes: list[Node], spec: GroupSpec = GroupSpec()) -> list[tuple[str, int, int, int, str]]:
    """(kind, gx, gy, gz, node) of seam groups (OR) and then main groups (MG).

    A seam avoids the seam before it; a main group avoids its left neighbour and the seams on
    both sides. Where nothing is left, the oldest demand is dropped first. While main groups
    are dealt, the node of the last seam counts one group less.
    """
    load, gx, gy, gz = Load(nodes), *spec.counts(meta)
    out, seam = [], {}

    def choose(demands: list) -> str:
        demands = [d for d in demands if d is not None]
        while True:
            found = load.least(set(demands))
            if found or not demands:
                return found
            demands.pop()

    last = None
    for z in range(gz):
        for y in range(gy - 1):
            seam[y, z] = last = load.give(choose([seam.get((y - 1, z))]), meta.nx * 2 * spec.slabs)
            out.append(("OR", 0, y, z, last))
    if last:
        load.groups[last] -= 1
    for z in range(gz):
        for y in range(gy):
            left = None
            for x in range(gx):
                left = load.give(choose([left, seam.get((y, z)), seam.get((y - 1, z))]), spec.rows * spec.cols * spec.slabs)
                out.append(("MG", x, y, z, left))
    if last:
        load.groups[last] += 1
    return out


def fill_replicas(chosen: list[str], load: Load, replicas: int = REPLICAS) -> list[str]:
    """Adds nodes by the rack rules: the second on another rack than the first; the third on the
    second's rack if racks differ, and on another one otherwise; anywhere where that fails."""
    out = list(dict.fromkeys(c for c in chosen if c))[:replicas]
    while len(out) < min(replicas, len(load.nodes)):
        racks = [load.nodes[n].rack for n in out]
        if not out:
            rule = None
        elif len(out) == 1 or len(set(racks)) == 1:
            rule = lambda n, r=racks[0]: n.rack != r
        else:
            rule = lambda n, r=racks[1]: n.rack == r
        found = load.least(set(out), rule) or load.least(set(out))
        out.append(load.give(found, 1, 0))
    return out


def group_table(spark: SparkSession, meta: GridMeta, nodes: list[Node], spec: GroupSpec = GroupSpec()) -> DataFrame:
    """The planned groups of a raster as (raster, kind, gx, gy, gz, value), with its DIMS row."""
    seed = spark.createDataFrame([(meta.raster,)], "raster string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(meta.raster, *r) for r in plan_groups(meta, nodes, spec)]
        rows.append((meta.raster, "DIMS", -1, -1, -1, f"{meta.nx}-{meta.ny}-{meta.nz}"))
        return pd.DataFrame(rows, columns=["raster", "kind", "gx", "gy", "gz", "value"])

    return seed.groupBy("raster").applyInPandas(run, "raster string, kind string, gx int, gy int, gz int, value string")


def tiles_of(spark: SparkSession, meta: GridMeta) -> DataFrame:
    a, b, c = _split(F.col("id"), meta.nx, meta.ny)
    return spark.range(meta.nx * meta.ny * meta.nz).select(a.alias("tx"), b.alias("ty"), c.alias("tz"))


def look_up_groups(tiles: DataFrame, groups: DataFrame, meta: GridMeta, spec: GroupSpec = GroupSpec()) -> DataFrame:
    """Adds mg_node, or_node and oc_node: nodes of a tile's main group, seam and right neighbour."""
    tx, ty, tz = F.col("tx"), F.col("ty"), F.col("tz")
    gx, gy, gz = main_group(spec, tx, ty, tz)
    rows = tiles.withColumns({"_m": F.struct(gx.alias("x"), gy.alias("y"), gz.alias("z")), "_r": row_partners(meta, spec, tx, ty, tz), "_c": right_partner(meta, spec, tx, ty, tz)})
    rows = rows.withColumn("_r", F.element_at(F.when(F.size("_r") > 0, F.col("_r")), -1))
    for key, kind, out in (("_m", "MG", "mg_node"), ("_r", "OR", "or_node"), ("_c", "MG", "oc_node")):
        table = groups.where(F.col("kind") == kind).select(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z")).alias(key), F.col("value").alias(out))
        rows = rows.join(table, key, "left")
    return rows.select("tx", "ty", "tz", "mg_node", "or_node", "oc_node")


def plan_tile_replicas(spark: SparkSession, meta: GridMeta, nodes: list[Node], spec: GroupSpec = GroupSpec()) -> DataFrame:
    """(tx, ty, tz, replicas): main group, seam and right neighbour, then filled by the rack rules.

    Tiles are filled slab by slab, each with its own counts, so slabs are independent tasks.
    """
    found = look_up_groups(tiles_of(spark, meta), group_table(spark, meta, nodes, spec), meta, spec)
    found = found.withColumn("slab", F.floor(F.col("tz") / spec.slabs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load = Load(nodes)
        pdf = pdf.sort_values(["tz", "ty", "tx"])
        out = [fill_replicas([r.mg_node, r.or_node, r.oc_node], load) for r in pdf.itertuples()]
        return pdf.assign(replicas=out)[["tx", "ty", "tz", "replicas"]]

    return found.groupBy("slab").applyInPandas(run, "tx int, ty int, tz int, replicas array<string>")


def column_chain(rows: int, cols: int, nodes: list[Node], writer: str) -> list[tuple[int, int, list[str]]]:
    """Chained placement of a 2D grid, in row order.

    The first tile of row 0 goes to the writer's node; each later one begins with the second
    replica of the tile to its left and avoids, if it can, the other replicas of the two tiles to
    its left. Tiles of other rows begin with the first two replicas of row 0 in their column.
    """
    load, top, out = Load(nodes), [], []
    seconds = dict.fromkeys(load.nodes, 0)

    def pick(taken: list[str], soft: list[str], rule) -> str:
        soft = list(soft)
        while True:
            free = [n for n in load.nodes if n not in taken and n not in soft and rule(load.nodes[n])]
            if free:
                return min(free, key=lambda n: (seconds[n], load.tiles[n], n))
            if not soft:
                return pick(taken, [], lambda n: True)
            soft.pop()

    for c in range(cols):
        first = writer if c == 0 else top[-1][1]
        soft = [n for t in reversed(top[-2:]) for n in t if n != first]
        rack = load.nodes[first].rack
        second = pick([first], soft, lambda n, r=rack: n.rack != r)
        seconds[second] += 1
        other = load.nodes[second].rack
        third = pick([first, second], [*soft], lambda n, r=other: n.rack == r)
        top.append([first, second, third])
        for n in top[-1]:
            load.give(n, 1)
    out += [(0, c, t) for c, t in enumerate(top)]
    for r in range(1, rows):
        for c in range(cols):
            two = top[c][:2]
            out.append((r, c, [*two, load.give(load.least(set(two)), 1)]))
    return out


def plan_column_chain(spark: SparkSession, raster: str, rows: int, cols: int, nodes: list[Node], writer: str) -> DataFrame:
    """(raster, row, col, replicas) of the chained placement."""
    seed = spark.createDataFrame([(raster,)], "raster string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(raster, *x) for x in column_chain(rows, cols, nodes, writer)], columns=["raster", "row", "col", "replicas"])

    return seed.groupBy("raster").applyInPandas(run, "raster string, row int, col int, replicas array<string>")


def static_placement(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files with the replicas that a placement table gives them."""
    return files.join(table, "file")


def clear_table(table: DataFrame, rasters: DataFrame) -> DataFrame:
    """A group table without the rows of some rasters."""
    return table.join(rasters.select("raster"), "raster", "left_anti")


def replicas_by_rack(replicas: DataFrame) -> DataFrame:
    """Adds ``shared``: whether another replica of the block is on the same rack."""
    return replicas.withColumn("shared", F.count("*").over(Window.partitionBy("block", "rack")) > 1)


def extra_replica(replicas: DataFrame, stale_before: int) -> DataFrame:
    """(block, node): the replica to drop of each block: the oldest heartbeat, else the least room.

    ``replicas`` has block, node, heartbeat and remaining; with a column ``rack``, replicas that
    share their rack are taken first, so that no block loses a rack without need.
    """
    if "rack" in replicas.columns:
        marked = replicas_by_rack(replicas)
        any_shared = F.max("shared").over(Window.partitionBy("block"))
        replicas = marked.withColumn("any_shared", any_shared).where(F.col("shared") | ~F.col("any_shared"))
    old = F.col("heartbeat") < stale_before
    return replicas.groupBy("block").agg(F.coalesce(F.min_by(F.when(old, F.col("node")), F.when(old, F.struct("heartbeat", "node"))), F.min_by("node", F.struct("remaining", "node"))).alias("node"))


def pipeline_order(writer: Column, replicas: Column) -> Column:
    """Replicas in the order of a write pipeline: each next one is the nearest to the one before.

    ``writer`` is a struct (node, rack) and ``replicas`` an array of such. A node is at distance
    0 from itself, 2 from its rack and 4 from others. The nearest trades places with the one
    whose turn it is; ties go to the front. Without a writer the first replica is its own.
    """

    def nearest(rows: Column, at: Column, i: Column) -> Column:
        distance = lambda r: F.when(r["node"] == at["node"], 0).when(r["rack"] == at["rack"], 2).otherwise(4)
        ranked = F.transform(rows, lambda r, p: F.when(p >= i, F.struct(distance(r).alias("d"), p.alias("p"))))
        return F.array_min(F.filter(ranked, lambda x: x.isNotNull()))["p"]

    def step(state: Column, i: Column) -> Column:
        rows, j = state["rows"], nearest(state["rows"], state["at"], i)
        swapped = F.transform(rows, lambda r, p: F.when(p == i, F.get(rows, j)).when(p == j, F.get(rows, i)).otherwise(r))
        return F.struct(swapped.alias("rows"), F.get(rows, j).alias("at"))

    start = F.struct(replicas.alias("rows"), F.coalesce(writer, F.get(replicas, F.lit(0))).alias("at"))
    turns = F.when(F.size(replicas) > 0, F.sequence(F.lit(0), F.size(replicas) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, step)["rows"]


def look_up_cells(index: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (row, col, ...) with the replicas that the grid index has for them, or null."""
    return cells.join(index.where("row >= 0").select("row", "col", "replicas"), ["row", "col"], "left")
