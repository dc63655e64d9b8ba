"""Half-edges of a plane graph: twin, next and face of each, and graphs cropped to a square.

A graph is a set of straight edges (x1, y1, x2, y2) that meet in their ends alone.
Either way of an edge is a half-edge; the one that follows is the next one clockwise
around its end, so that faces lie to the left and only the outside has a negative
area. Around a vertex there is a window of as many rows as edges meet there; faces
come from the components of what follows what, their order from pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import clip, perimeter_at
from tessella.operators.components import components, dense
from tessella.plans.stage import drop, running_sum, staged


def half_edges(edges: DataFrame) -> DataFrame:
    """(id, x, y, tx, ty, twin, next): ids 0, 1, ... by pairs, in the order of the edges; repeats and edges of no length are left out."""
    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    own = edges.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).where("p <> q").distinct()
    own = own.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.x").alias("tx"), F.col("q.y").alias("ty"), F.lit(2).cast("long").alias("two"))
    one = running_sum(own, ["x", "y", "tx", "ty"], "two", "id").select("id", "x", "y", "tx", "ty")
    half = staged(one.unionByName(one.select((F.col("id") + 1).alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("x").alias("tx"), F.col("y").alias("ty"))), "half-edges")
    around = Window.partitionBy("x", "y").orderBy(F.atan2(F.col("ty") - F.col("y"), F.col("tx") - F.col("x")), "id")
    last = F.last("id").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # What precedes an outgoing half-edge follows its twin, which comes in.
    follows = half.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.coalesce(F.lag("id").over(around), last).alias("next"))
    return half.join(follows, "id").select("id", "x", "y", "tx", "ty", F.col("id").bitwiseXOR(F.lit(1)).alias("twin"), "next")


def faces(half: DataFrame) -> DataFrame:
    """half_edges() with face, the least id of its boundary, and seq, the place on it from 0.

    A face with holes has a boundary for each hole, which counts as a face of its own
    with a negative area, as the outside does.
    """
    half = staged(half, "half-edges")
    loops = components(half.select(F.col("id").alias("a"), F.col("next").alias("b")))
    named = staged(half.join(loops.withColumnRenamed("component", "face"), "id", "left").withColumn("face", F.coalesce("face", "id")), "faces")
    # Each half-edge counts the steps to the last of its face; faces in which all have done so are out of the rounds.
    end = F.col("next") == F.col("face")
    state = staged(named.select("id", "face", F.when(end, F.col("id")).otherwise(F.col("next")).alias("to"), F.when(end, 0).otherwise(1).cast("long").alias("d")), "steps")
    steps = None
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        new = staged(state.join(ahead, "to").select("id", "face", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("moved")), "steps")
        drop(state)
        open_ = staged(new.where("moved").select("face").distinct(), "open")
        shut = staged(new.join(open_, "face", "left_anti").select("id", "d"), "counted")
        steps = shut if steps is None else steps.unionByName(shut)
        more = bool(open_.head(1))
        if more:
            state = staged(new.join(open_, "face").drop("moved"), "steps")
        drop(new, open_)
        if not more:
            break
    size = named.groupBy("face").agg(F.count("*").alias("n"))
    return named.join(steps, "id").join(size, "face").select(*half.columns, "face", (F.col("n") - 1 - F.col("d")).alias("seq"))


def outlines(found: DataFrame) -> DataFrame:
    """Of faces(): (face, n_edges, area), the area of outer boundaries negative."""
    cross = F.col("x") * F.col("ty") - F.col("tx") * F.col("y")
    return found.groupBy("face").agg(F.count("*").alias("n_edges"), (F.sum(cross) / 2).alias("area"))


def neighbours(found: DataFrame) -> DataFrame:
    """Of faces(): distinct pairs (a, b), a < b, of faces on both sides of an edge."""
    other = found.select(F.col("id").alias("twin"), F.col("face").alias("b"))
    return found.select("twin", F.col("face").alias("a")).join(other, "twin").where("a < b").select("a", "b").distinct()


def exterior(points: DataFrame, lo: float, hi: float) -> DataFrame:
    """Edges around the square [lo, hi]: between points (x, y) on its border and its corners, in the order of the border."""
    corners = points.sparkSession.createDataFrame([(float(x), float(y)) for x in (lo, hi) for y in (lo, hi)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    at = points.where((x == lo) | (x == hi) | (y == lo) | (y == hi)).select("x", "y").unionByName(corners).distinct()
    at = staged(at.withColumn("place", perimeter_at(x, y, F.lit(float(lo)), F.lit(float(hi)))), "border")
    ranked = staged(at.join(dense(at, "place"), F.col("place") == F.col("old")).select("x", "y", "new"), "border")
    n = ranked.agg(F.max("new")).first()[0]
    after = ranked.select((F.pmod(F.col("new") - 2, F.lit(n)) + 1).alias("new"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return ranked.join(after, "new").select(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def crop(edges: DataFrame, lo: float, hi: float, digits: int = 6) -> DataFrame:
    """The part of a graph in the square [lo, hi], closed by the square's own border.

    Edges with an end outside are cut; edges along the border give way to exterior()'s,
    which run between all points where the graph meets it. Coordinates are rounded.
    """
    a, b = (F.col("x1").cast("double"), F.col("y1").cast("double")), (F.col("x2").cast("double"), F.col("y2").cast("double"))
    seen, enter, leave = clip(a, b, lo, hi)
    at = lambda p, q, t: F.round(p + t * (q - p), digits) + 0.0
    cut = edges.where(seen & (enter <= leave)).select(*(at(a[k], b[k], t).alias(f"{c}{n}") for n, t in ((1, enter), (2, leave)) for k, c in ((0, "x"), (1, "y"))))
    cut = staged(cut.distinct(), "cut")
    on = lambda c, v: (F.col(f"{c}1") == v) & (F.col(f"{c}2") == v)
    inner = cut.where(~(on("x", lo) | on("x", hi) | on("y", lo) | on("y", hi)) & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))
    ends = cut.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(cut.select(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return inner.unionByName(exterior(ends, lo, hi))
