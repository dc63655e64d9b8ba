"""Lines on corner graphs: vertices in order by pointer doubling, and colours without clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import wrap
from tessella.operators.components import components, edge_key
from tessella.plans.stage import staged

#: Corners are packed as x * BIT + y, for coordinates below 2^31.
BIT = 1 << 31


def _half_edges(edges: DataFrame, w: int, h: int) -> DataFrame:
    """(e, way, u, v): each boundary edge once in either way, between packed corners of the torus."""
    e = edge_key()
    at = lambda x, y: wrap(F.col(x), w) * BIT + wrap(F.col(y), h)
    one = edges.select(e.alias("e"), at("x1", "y1").alias("u"), at("x2", "y2").alias("v"))
    return one.select("e", F.lit(0).alias("way"), "u", "v").unionByName(one.select("e", F.lit(1).alias("way"), F.col("v").alias("u"), F.col("u").alias("v")))


def ordered_lines(edges: DataFrame, w: int, h: int) -> DataFrame:
    """Boundary edges -> (line, seq, x, y): the corners of every line in order, seq from 0.

    A line runs between corners of degree other than 2; a loop without one begins
    and ends at its least corner. line is the least packed edge of the line. Every
    edge is on one line, those between two junctions included.

    Half-edges know the one that follows; log2(longest line) self-joins of what
    has not reached its end double the distance that each one sees.
    """
    half = staged(_half_edges(edges, w, h).withColumn("id", F.col("e") * 2 + F.col("way")))
    corner = half.groupBy("u").agg(F.count("*").alias("degree"), F.min("e").alias("a"), F.max("e").alias("b"))
    chains = components(corner.where("degree = 2").select("a", "b"))
    named = staged(half.join(chains.withColumnRenamed("id", "e"), "e", "left").withColumn("line", F.coalesce("component", "e")).drop("component"))
    loose = named.join(corner.select("u", "degree"), "u").groupBy("line").agg(F.min("u").alias("u"), F.max(F.col("degree") != 2).alias("ended")).where("not ended")
    stops = corner.where("degree <> 2").select("u").unionByName(loose.select("u")).distinct()
    after = named.join(stops, "u", "left_anti").select(F.col("u").alias("v"), F.col("e").alias("f"), F.col("id").alias("next"))
    linked = named.select("id", "e", "v").join(after, "v", "left").where("f is null or f <> e").select("id", "next")
    # At an inner corner a half-edge meets its own reverse and one other: the other follows.
    state = staged(named.select("id").join(linked, "id", "left").select("id", F.coalesce("next", "id").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("d")))
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        new = staged(state.join(ahead, "to").select("id", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").head(1):
            break
    full = named.join(state, "id")
    way = full.groupBy("line").agg(F.min("to").alias("to"), F.max("d").alias("last"))
    kept = staged(full.join(way, ["line", "to"]).select("line", (F.col("last") - F.col("d") + 1).alias("seq"), "u", "v"))
    both = kept.select("line", "seq", F.col("v").alias("c")).unionByName(kept.where("seq = 1").select("line", F.lit(0).cast("long").alias("seq"), F.col("u").alias("c")))
    return both.select("line", "seq", F.shiftright("c", 31).alias("x"), (F.col("c") % BIT).alias("y"))


def border_map(lines: DataFrame, w: int, h: int) -> DataFrame:
    """Lines (line, seq, x, y) -> (x, y, side, line): the sides of cells that they run along; of two on one side the higher number."""
    after = Window.partitionBy("line").orderBy("seq")
    steps = lines.select("line", "x", "y", F.lead("x").over(after).alias("nx"), F.lead("y").over(after).alias("ny")).where("nx is not null")
    low = lambda c, n, size: F.when((F.col(c) != F.col(n)) & (wrap(F.col(c) + 1, size) != F.col(n)), F.col(n)).otherwise(F.col(c)).alias(c)
    sides = steps.select(low("x", "nx", w), low("y", "ny", h), F.when(F.col("x") != F.col("nx"), "low_y").otherwise("low_x").alias("side"), "line")
    return sides.groupBy("x", "y", "side").agg(F.max("line").alias("line"))


def clashes(lines: DataFrame) -> DataFrame:
    """(a, b), a < b: lines (line, seq, x, y) that end in one corner; at most four meet in a corner of a raster."""
    last = lines.groupBy("line").agg(F.max("seq").alias("seq"))
    ends = lines.where("seq = 0").select("line", "x", "y").unionByName(lines.join(last, ["line", "seq"]).select("line", "x", "y")).distinct()
    return ends.join(ends.withColumnRenamed("line", "b"), ["x", "y"]).where("line < b").select(F.col("line").alias("a"), "b").distinct()


def colour(ids: DataFrame, pairs: DataFrame, seed: int = 1) -> DataFrame:
    """ids (line), pairs (a, b) that must differ -> (line, colour), colours from 0.

    Greedy in a random order, many at once: in each round the lines that come
    before all their uncoloured neighbours take the least colour free among the
    coloured ones. That is what one pass in this order would give.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)), F.col(c))
    both = staged(pairs.select(F.col("a").alias("line"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("line"), F.col("a").alias("other"))).where("line <> other").distinct())
    left, done = staged(ids.select("line").distinct()), None
    while left.head(1):
        open_ = both.join(left, "line", "left_semi").join(left.select(F.col("line").alias("other")), "other", "left_semi")
        waits = open_.where(rank("other") < rank("line")).select("line").distinct()
        now = left.join(waits, "line", "left_anti")
        if done is None:
            new = now.withColumn("colour", F.lit(0))
        else:
            used = both.join(done.select(F.col("line").alias("other"), "colour"), "other").groupBy("line").agg(F.collect_set("colour").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
            new = now.join(used, "line", "left").select("line", F.coalesce(free, F.lit(0)).alias("colour"))
        new = staged(new)
        done = new if done is None else done.unionByName(new)
        left = staged(left.join(new, "line", "left_anti"))
    return done if done is not None else left.withColumn("colour", F.lit(0))
