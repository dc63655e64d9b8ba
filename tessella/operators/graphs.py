"""Graphs of corners and of regions: vertices numbered as they are met, edges in their order, segments of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import wrap
from tessella.operators.components import components, dense
from tessella.operators.raster import beside
from tessella.plans.stage import running_sum, staged

#: Slots of a vertex's edges: along y upwards and downwards, along x downwards and upwards.
UP_Y, DOWN_Y, DOWN_X, UP_X = range(4)


def corner_graph(grid: DataFrame, w: int, h: int) -> tuple[DataFrame, DataFrame]:
    """Cells (x, y, label) -> vertices (visit, x, y) and edges (src, dst, slot), both ways, on the corners of the torus.

    Cells are met by rows; of each, its border to (x - 1, y), then that to (x, y - 1).
    A corner's visit number, from 0, is its place among the corners as these borders
    first touch them, near end first.
    """
    cell = (F.col("x") * h + F.col("y")) * 4
    across = beside(grid, -1, 0, w, h).where("label <> other")
    along = beside(grid, 0, -1, w, h).where("label <> other")
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    one = across.select(spot(F.col("x"), F.col("y")).alias("a"), spot(F.col("x"), wrap(F.col("y") + 1, h)).alias("b"), cell.alias("touch"), F.lit(UP_Y).alias("slot"))
    two = along.select(spot(F.col("x"), F.col("y")).alias("a"), spot(wrap(F.col("x") + 1, w), F.col("y")).alias("b"), (cell + 2).alias("touch"), F.lit(UP_X).alias("slot"))
    edges = staged(one.unionByName(two))
    met = edges.select(F.col("a").alias("c"), "touch").unionByName(edges.select(F.col("b").alias("c"), (F.col("touch") + 1).alias("touch")))
    first = met.groupBy("c").agg(F.min("touch").alias("touch"))
    numbered = staged(first.join(dense(first, "touch"), F.col("touch") == F.col("old")).select((F.col("new") - 1).alias("visit"), "c"))
    ends = edges.join(numbered.select(F.col("c").alias("a"), F.col("visit").alias("src")), "a").join(numbered.select(F.col("c").alias("b"), F.col("visit").alias("dst")), "b")
    ends = ends.select("src", "dst", "slot")
    back = ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("slot").bitwiseXOR(F.lit(1)).alias("slot"))
    return numbered.select("visit", "c.x", "c.y"), ends.unionByName(back)


def traversal(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, x1, y1, x2, y2): each edge once, from the vertex visited first, in the order of these visits, then of slots."""
    once = edges.where("src < dst")
    one, two = (vertices.select(F.col("visit").alias(v), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, v in ((1, "src"), (2, "dst")))
    named = once.join(one, "src").join(two, "dst").withColumn("one", F.lit(1).cast("long"))
    return running_sum(named, ["src", "slot"], "one", "ord").select("ord", "x1", "y1", "x2", "y2")


def segments(vertices: DataFrame, edges: DataFrame, start: int = 0) -> DataFrame:
    """(x1, y1, x2, y2): each edge once, of the part of the graph that hangs together with the vertex of that visit number."""
    part = staged(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    own = part.join(part.where(F.col("id") == start).select("component"), "component").select(F.col("id").alias("src"))
    return traversal(vertices, edges.join(own, "src", "left_semi")).drop("ord")


def edge_counts(pairs: DataFrame) -> DataFrame:
    """(label, edges): number of neighbours of each label in pairs (a, b)."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    return both.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("edges"))


def touching_interior(rings: DataFrame, lo: float, hi: float) -> DataFrame:
    """rings (ring) that have a vertex strictly inside the square [lo, hi]."""
    inner = lambda p: (p["x"] > lo) & (p["x"] < hi) & (p["y"] > lo) & (p["y"] < hi)
    return rings.where(F.exists("ring", inner))
