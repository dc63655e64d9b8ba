"""Joins of boxes of very unlike size: each box lives on the level of a grid pyramid whose cells are as large as it.

A box covers at most four cells of its own level and of all coarser ones. Two boxes meet
on the level of the larger, in the cell that holds the lower corner of what they share;
so a large box is never cut into small cells, small ones do not meet in large cells, and
no pair is found twice. Pairs carry their rows along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import in_ring
from tessella.plans.stage import staged

#: Levels of the pyramid, the finest first; cells of the last are the extent's size.
LEVELS = 20
#: Rows of one cell that are joined to as many of the other side in one task.
BLOCK = 1 << 11
CELL, CORNERS = ["level", "cx", "cy"], ["x0", "y0", "x1", "y1"]


def _placed(boxes: DataFrame, name: str, x0: float, y0: float, size: float, level: Column) -> DataFrame:
    """boxes with a level and a row for each of their cells on it."""
    side = F.pow(F.lit(2.0), F.col("level") - LEVELS) * size
    cell = lambda c, at: F.floor((F.col(f"{name}{c}") - at) / side)
    across = boxes.withColumn("level", level).withColumn("cx", F.explode(F.sequence(cell("x0", x0), cell("x1", x0))))
    return across.withColumn("cy", F.explode(F.sequence(cell("y0", y0), cell("y1", y0))))


def _levelled(boxes: DataFrame, name: str, size: float) -> DataFrame:
    longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.when(longest <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(longest / size)).cast("int") + LEVELS)))
    return boxes.withColumn("level", level).withColumnsRenamed({c: f"{name}{c}" for c in ("x0", "y0", "x1", "y1", "level")})


def _blocked(left: DataFrame, right: DataFrame) -> DataFrame:
    """left joined to right on level, cx and cy, the rows of crowded cells in blocks of either side, so that no cell is one task's."""
    one, two = (t.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).alias(n)) for t, n in ((left, "rows"), (right, "columns")))
    crowded = staged(one.join(two, CELL).where("rows > 1 or columns > 1"), "crowded")
    if not crowded.head(1):
        return left.join(right.hint("merge"), CELL)
    deal = lambda t, n: F.pmod(F.xxhash64(*t.columns), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    r, c = (F.coalesce(n, F.lit(1).cast("long")) for n in ("rows", "columns"))
    some = F.broadcast(crowded)
    left = left.join(some, CELL, "left").withColumn("row", deal(left, r)).withColumn("column", each(c)).drop("rows", "columns")
    right = right.join(some, CELL, "left").withColumn("column", deal(right, c)).withColumn("row", each(r)).drop("rows", "columns")
    return left.join(right.hint("merge"), [*CELL, "row", "column"])


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left and right, both with x0, y0, x1, y1, whose boxes share a point, with left's corners as ax0 and so on and right's as bx0; None without boxes."""
    keep = "x0 <= x1 and y0 <= y1"
    one, two = left.where(keep), right.where(keep)
    ends = one.select(*CORNERS).unionByName(two.select(*CORNERS)).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if ends[0] is None:
        return None
    x0, y0 = float(ends[0]), float(ends[1])
    size = max(ends[2] - x0, ends[3] - y0) or 1.0
    one, two = _levelled(one, "a", size), _levelled(two, "b", size)
    found = []
    # The larger box of a pair is on its own level, the other comes up to it; of equal ones the left one counts as larger.
    for big, name, small, other, above in ((one, "a", two, "b", 0), (two, "b", one, "a", 1)):
        levels = sorted(r[0] for r in big.select(f"{name}level").distinct().collect())  # at most LEVELS + 1
        up = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"{other}level") + above))  # noqa: B023
        if levels:
            found.append(_blocked(_placed(small, other, x0, y0, size, up), _placed(big, name, x0, y0, size, F.col(f"{name}level"))))
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    side = F.pow(F.lit(2.0), F.col("level") - LEVELS) * size
    low = lambda c, at: F.floor((F.greatest(f"a{c}0", f"b{c}0") - at) / side)
    shared = (F.greatest("ax0", "bx0") <= F.least("ax1", "bx1")) & (F.greatest("ay0", "by0") <= F.least("ay1", "by1"))
    return met.where(shared & (F.col("cx") == low("x", x0)) & (F.col("cy") == low("y", y0)))


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (id, x0, y0, x1, y1), right (other, x0, y0, x1, y1) -> (id, other) of boxes that share a point, borders included.

    Boxes without extent are points; those with a null corner meet nothing.
    """
    met = _pairs(left.select("id", *CORNERS), right.select("other", *CORNERS))
    if met is None:
        return left.select("id").withColumn("other", F.lit(None).cast(right.schema["other"].dataType)).where("false")
    return met.select("id", "other")


def visible(a: tuple[Column, Column], b: tuple[Column, Column], box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """As geometry.clip, for a box (x0, y0, x1, y1) of columns: whether a part of the segment is in it, and its ends as parameters."""
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q, lo, hi in ((a[0], b[0], box[0], box[2]), (a[1], b[1], box[1], box[3])):
        t, u = F.try_divide(lo - p, q - p), F.try_divide(hi - p, q - p)
        enter = F.greatest(enter, F.coalesce(F.least(t, u), F.lit(0.0)))
        leave = F.least(leave, F.coalesce(F.greatest(t, u), F.lit(1.0)))
        outside = outside | ((p == q) & ((p < lo) | (p > hi)))
    return ~outside & (enter <= leave), enter, leave


def segments_in_boxes(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """segments (id, ax, ay, bx, by), boxes (box_id, x0, y0, x1, y1) -> (id, box_id, px, py, qx, qy): the part of each segment in each box."""
    low, high = (lambda c, f=f: f(F.col(f"a{c}"), F.col(f"b{c}")) for f in (F.least, F.greatest))
    left = segments.select("id", "ax", "ay", "bx", "by", *(f(c).alias(f"{c}{k}") for k, f in ((0, low), (1, high)) for c in "xy"))
    both = _pairs(left, boxes.select("box_id", *CORNERS))
    if both is None:
        both = left.join(boxes.select("box_id", *(F.col(c).alias(f"b{c}") for c in CORNERS)).where("false"), F.lit(True))
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    seen, enter, leave = visible(a, b, tuple(map(F.col, ("bx0", "by0", "bx1", "by1"))))
    at = lambda k, t: a[k] + t * (b[k] - a[k])
    return both.where(seen).select("id", "box_id", at(0, enter).alias("px"), at(1, enter).alias("py"), at(0, leave).alias("qx"), at(1, leave).alias("qy"))


def points_in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """points (id, px, py), rings (ring_id, ring) -> (id, ring_id) of the points inside."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = rings.select(F.col("ring_id").alias("other"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    spots = points.select("id", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    near = box_pairs(spots, boxed).join(points.select("id", "px", "py"), "id").join(rings.select(F.col("ring_id").alias("other"), "ring"), "other")
    return near.where(in_ring(F.col("ring"), F.col("px"), F.col("py"))).select("id", F.col("other").alias("ring_id"))
