"""Neighbour joins on label rasters (x, y, label): stencils, boundaries, adjacency, corner graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import wrap

#: Eight neighbours; the reference stencil has (-1, -1) twice and lacks (1, -1).
MOORE = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
REFERENCE = ((-1, -1), (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, 0), (1, 1))


def neighbours(cells: DataFrame, w: int, h: int, stencil: tuple = REFERENCE) -> DataFrame:
    """(x, y, nx, ny): a row for each cell and stencil entry, on the torus."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in stencil])
    out = cells.select("x", "y", F.explode(steps).alias("d"))
    return out.select("x", "y", wrap(F.col("x") + F.col("d.i"), w).alias("nx"), wrap(F.col("y") + F.col("d.j"), h).alias("ny"))


def clamped(cells: DataFrame, w: int, h: int) -> DataFrame:
    """(x, y, nx, ny): the four neighbours inside the grid."""
    steps = F.array(*[F.struct((F.col("x") + i).alias("nx"), (F.col("y") + j).alias("ny")) for i, j in ((-1, 0), (0, -1), (0, 1), (1, 0))])
    out = cells.select("x", "y", F.explode(steps).alias("n")).select("x", "y", "n.nx", "n.ny")
    return out.where(F.col("nx").between(0, w - 1) & F.col("ny").between(0, h - 1))


def candidates(grid: DataFrame, w: int, h: int, stencil: tuple = REFERENCE) -> DataFrame:
    """(label, x, y, support): unassigned neighbours of each label, with how many stencil entries have that label."""
    near = neighbours(grid.where("label is null"), w, h, stencil)
    known = grid.where("label is not null").select(F.col("x").alias("nx"), F.col("y").alias("ny"), "label")
    return near.join(known, ["nx", "ny"]).groupBy("label", "x", "y").agg(F.count("*").alias("support"))


def best_candidates(found: DataFrame) -> DataFrame:
    """Of each label, the candidates with most support: a grouped maximum joined back, so no label is one task's."""
    top = found.groupBy("label").agg(F.max("support").alias("support"))
    return found.join(top, ["label", "support"]).select("label", "x", "y", "support")


def beside(grid: DataFrame, dx: int, dy: int, w: int, h: int) -> DataFrame:
    """grid with ``other``, the label of the cell at (x + dx, y + dy) on the torus."""
    moved = grid.select(wrap(F.col("x") - dx, w).alias("x"), wrap(F.col("y") - dy, h).alias("y"), F.col("label").alias("other"))
    return grid.join(moved, ["x", "y"])


def boundary_edges(grid: DataFrame, w: int, h: int, mode: str = "full") -> DataFrame:
    """Unit edges (x1, y1, x2, y2, group_a, group_b) between cells of different labels.

    full: every pair of neighbours on the torus. reference: without the wraps and
    row pairs that the reference leaves out; its column wraps lie at y = 0.
    """
    across = beside(grid, 0, 1, w, h).where("label <> other")
    along = beside(grid, 1, 0, w, h).where("label <> other")
    if mode == "reference":
        across = across.where((F.col("y") < h - 1) | (F.col("x") < w - 1))
        along = along.where(F.col("y") < h - 1)
        level = F.when(F.col("y") == h - 1, F.lit(0)).otherwise(F.col("y") + 1)
    else:
        level = F.col("y") + 1
    side = F.col("x") + 1
    one = across.select("x", level.alias("y1"), side.alias("x2"), level.alias("y2"), F.col("label").alias("group_a"), F.col("other").alias("group_b"))
    one = one.select(F.col("x").alias("x1"), "y1", "x2", "y2", "group_a", "group_b")
    two = along.select(side.alias("x1"), F.col("y").alias("y1"), side.alias("x2"), (F.col("y") + 1).alias("y2"), F.col("label").alias("group_a"), F.col("other").alias("group_b"))
    return one.unionByName(two)


def adjacency(grid: DataFrame, w: int, h: int) -> DataFrame:
    """Distinct pairs a < b of labels that touch on the torus."""
    both = beside(grid, 1, 0, w, h).unionByName(beside(grid, 0, 1, w, h)).where("label <> other")
    return both.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def corner_degrees(edges: DataFrame, w: int, h: int) -> DataFrame:
    """(cx, cy, degree) of lattice corners on boundary edges, corners meeting across the wrap."""
    a = edges.select(wrap(F.col("x1"), w).alias("cx"), wrap(F.col("y1"), h).alias("cy"))
    b = edges.select(wrap(F.col("x2"), w).alias("cx"), wrap(F.col("y2"), h).alias("cy"))
    return a.unionByName(b).groupBy("cx", "cy").agg(F.count("*").alias("degree"))


def border_map(edges: DataFrame, w: int, h: int) -> DataFrame:
    """(x, y, side, line): which side of which cell a labelled edge lies on; the highest label wins."""
    level = F.col("y1") == F.col("y2")
    out = edges.select(wrap(F.least("x1", "x2"), w).alias("x"), wrap(F.least("y1", "y2"), h).alias("y"), F.when(level, "low_y").otherwise("low_x").alias("side"), "label")
    return out.groupBy("x", "y", "side").agg(F.max("label").alias("line"))


def contract(pairs: DataFrame, gone: int, into: int) -> DataFrame:
    """Adjacency pairs after region ``gone`` has merged into another: rewritten, distinct, without loops."""
    to = lambda c: F.when(F.col(c) == gone, F.lit(into)).otherwise(F.col(c))
    moved = pairs.select(to("a").alias("p"), to("b").alias("q")).where("p <> q")
    return moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
