"""Random partitions of tori, set-based: growth by first passage, and cuts along random walks.

All maps and all cells of a table take part in every round, so nothing is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.functions.geometry import wrap
from tessella.operators.raster import MOORE, REFERENCE
from tessella.plans.stage import drop, new_path, staged

#: Steps of growth that one stage holds.
STEPS = 4
#: The share of the waiting cells that are taken before a span of time ends.
SHARE = 0.9
#: Up to so many cells of all maps grow in one span.
WHOLE = 1 << 22
#: Later than any time.
_ENDLESS = 1 << 62


def _delay(map_id, label, x, y, weight, seed: int):
    """Whole time a region needs to take a cell: exponential, the faster the greater its weight; at least 1."""
    u = draws.uniform(x * F.lit(1 << 31) + y, (map_id * 1_000_003 + label) * 64 + seed)
    return (F.lit(1) + F.floor(draws.exponential(u, 1.0) * 1_000_000 / weight)).cast("long")


def weighted(seeds: DataFrame, weights: draws.Distribution) -> DataFrame:
    """seeds (map_id, label, x, y) with ``weight``: a draw for each region of each map, at least 1."""
    return seeds.withColumn("weight", F.greatest(F.lit(1.0), weights(F.col("map_id") * 1_000_003 + F.col("label")).cast("double")))


def grow(seeds: DataFrame, w: int, h: int, seed: int = 1, stencil: str = "reference", share: float | None = None) -> DataFrame:
    """seeds (map_id, label, x, y, weight) -> (map_id, x, y, label): every cell of every map with a seed assigned.

    All regions grow at once: one that has a cell takes a neighbour after an
    exponential time that its weight shortens, and the first to come keeps it. Such
    times have no memory, so the next cell taken is any pair of a region and a free
    cell beside it, in proportion to the region's weight: the law of drawing such pairs
    one at a time, up to whole times. A region's chance thus grows with its border,
    unlike where regions are drawn by weight first and then one of their cells.
    Each region is connected under the stencil. Of seeds on one cell the lowest label
    stays; of arrivals at one time too.

    Time passes in spans. A span ends where a share of the waiting cells, those beside
    the assigned ones, have been taken; within it cells look anew at what their
    neighbours' regions would bring, until none changes: cells are right in the order
    of their times. Only the cells of the span, those that wait, and the rim take part,
    the rim being assigned cells with a free one beside them; so the work is that of
    each cell's own span, not of the grid in every round. The share decides on speed
    alone; where none is given it is SHARE, or one span for all if there are few cells.
    """
    spark = seeds.sparkSession
    moves = {(i % w, j % h) for i, j in (REFERENCE if stencil == "reference" else MOORE)} - {(0, 0)}
    beside = moves | {(-i % w, -j % h) for i, j in moves}
    key = ["map_id", "x", "y"]

    def spread(cells, by, *columns):
        """A row for each neighbour of each cell."""
        to = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in sorted(by)])
        return cells.select("map_id", "x", "y", *columns, F.explode(to).alias("d")).select("map_id", wrap(F.col("x") + F.col("d.i"), w).alias("x"), wrap(F.col("y") + F.col("d.j"), h).alias("y"), *columns)

    labels = seeds.select(F.col("map_id").cast("long").alias("map_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"))
    weights = labels.groupBy("map_id", "label").agg(F.max(F.greatest(F.lit(1.0), "weight")).alias("weight"))
    first = labels.groupBy("map_id", wrap(F.col("x"), w).alias("x"), wrap(F.col("y"), h).alias("y")).agg(F.min("label").alias("label"))
    if not moves:
        return first.select(*key, "label")
    # A region's weight travels with it. Nothing comes before 0, so seeds keep their cells, and the rim is at -1.
    held = staged(first.join(weights, ["map_id", "label"]).select(*key, F.struct(F.lit(0).cast("long").alias("at"), "label", "weight").alias("best")), "seeds")
    whole = share is None and held.select("map_id").distinct().count() * w * h <= WHOLE
    path, spans, waits, rim = new_path(spark, "grown"), 0, held, None
    while True:
        until = waits.agg(F.percentile_approx("best.at", share or SHARE)).first()[0]
        if until is None:
            break
        until = _ENDLESS if whole else until
        base = waits
        if rim is not None:
            base = base.unionByName(rim.select(*key, F.struct(F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("double").alias("weight")).alias("best")))
        taken = F.col("best.at").between(0, until)
        now, last = base, None
        while True:
            new = now
            for _ in range(STEPS):
                come = (F.col("best.at") + _delay(F.col("map_id"), F.col("best.label"), F.col("x"), F.col("y"), F.col("best.weight"), seed)).alias("at")
                to = spread(new.where(taken), moves, "best").select(*key, F.struct(come, F.col("best.label").alias("label"), F.col("best.weight").alias("weight")).alias("best"))
                new = base.unionByName(to).groupBy(*key).agg(F.min("best").alias("best"))
            new = staged(new, "growth")
            if now is not base:
                drop(now)
            now = new
            state = now.where(taken).agg(F.count("*"), F.sum(F.xxhash64(*key, "best.label", "best.at").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
        now.where(taken).select(*key, F.col("best.label").alias("label")).write.mode("overwrite").parquet(f"{path}/span={spans}")
        spans += 1
        if whole:
            drop(now)
            break
        # left: free cells beside one. All assigned neighbours of a new cell are new or were in the rim, as it was free.
        known = now.where(taken).select(*key, F.lit(True).alias("new"), F.lit(len(beside)).alias("left"))
        if rim is not None:
            known = known.unionByName(rim.select(*key, F.lit(False).alias("new"), "left"))
        none = F.lit(None)
        seen = spread(known, beside, "new").select(*key, none.cast("boolean").alias("new"), none.cast("int").alias("left"), F.col("new").cast("int").alias("by_new"), F.lit(1).alias("by_any"))
        both = known.select("*", F.lit(0).alias("by_new"), F.lit(0).alias("by_any")).unionByName(seen)
        counted = both.groupBy(*key).agg(F.max("new").alias("new"), F.max("left").alias("left"), F.sum("by_new").alias("by_new"), F.sum("by_any").alias("by_any")).where("left is not null")
        after = staged(counted.select(*key, (F.col("left") - F.when(F.col("new"), F.col("by_any")).otherwise(F.col("by_new"))).cast("int").alias("left")).where("left > 0"), "rim")
        drop(held, rim)
        held, rim, waits = now, after, now.where(F.col("best.at") > until)
    drop(held, rim)
    if not spans:
        return first.select(*key, "label")
    return spark.read.schema("map_id long, x long, y long, label long").parquet(path).select(*key, "label")


def paths(maps: DataFrame, w: int, h: int, cuts: int, length: int, alpha: float, seed: int) -> DataFrame:
    """(map_id, walk, step, x, y): the corners of random walks, two ways from each cut's first corner, as long as asked.

    A walk is one fold: its angle turns by a normal angle, it steps along x or y in
    proportion to its direction, and stays where it is rather than go back at once.
    """
    walks = maps.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(2 * cuts - 1))).alias("walk"))
    cut, back = F.floor(F.col("walk") / 2), F.col("walk") % 2
    key = F.col("map_id") * F.lit(1 << 20) + cut
    begin = walks.select("map_id", "walk", draws.uniform_int(draws.uniform(key, 4 * seed), 0, w - 1).cast("long").alias("sx"), draws.uniform_int(draws.uniform(key, 4 * seed + 1), 0, h - 1).cast("long").alias("sy"), (draws.uniform(key, 4 * seed + 2) * 2 * F.pi() + back * F.pi()).alias("angle"), (key * 2 + back).alias("key"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("angle").alias("angle"), zero.alias("dx"), zero.alias("dy"), F.array(corner(F.col("sx"), F.col("sy"))).alias("seen"))

    def step(s, n):
        one, two, three = (draws.uniform(F.col("key"), n * 4 + (seed << 16) + k) for k in range(3))
        return draws.let(F.struct((s["angle"] + draws.normal(one, two, 0.0, alpha)).alias("angle"), three.alias("u")), lambda t: _turned(s, t["angle"], t["u"]))

    def _turned(s, angle, u):
        cos, sin = F.cos(angle), F.sin(angle)
        along = u < F.abs(cos) / (F.abs(cos) + F.abs(sin))
        sign = lambda v: F.when(v < 0, -1).otherwise(1).cast("long")
        mx, my = F.when(along, sign(cos)).otherwise(zero), F.when(along, zero).otherwise(sign(sin))
        return F.element_at(F.transform(F.array(F.struct(mx.alias("x"), my.alias("y"))), lambda m: _stepped(s, m["x"], m["y"], angle)), 1)

    def _stepped(s, mx, my, angle):
        go = (mx + s["dx"] != 0) | (my + s["dy"] != 0)
        x, y = F.when(go, wrap(s["x"] + mx, w)).otherwise(s["x"]), F.when(go, wrap(s["y"] + my, h)).otherwise(s["y"])
        seen = F.when(go, F.concat(s["seen"], F.array(corner(x, y)))).otherwise(s["seen"])
        return F.struct(x.alias("x"), y.alias("y"), angle.alias("angle"), F.when(go, mx).otherwise(s["dx"]).alias("dx"), F.when(go, my).otherwise(s["dy"]).alias("dy"), seen.alias("seen"))

    done = begin.select("map_id", "walk", F.aggregate(F.sequence(F.lit(1), F.lit(length)), start, step)["seen"].alias("seen"))
    return done.select("map_id", "walk", F.posexplode("seen").alias("step", "c")).select("map_id", "walk", "step", "c.x", "c.y")


def walk_cuts(maps: DataFrame, w: int, h: int, cuts: int = 6, alpha: float = 0.05, seed: int = 1, length: int | None = None) -> DataFrame:
    """maps (map_id) -> (map_id, x, y, side, cut): sides of cells that random walks pass, both ways from each cut's first corner.

    A walk ends at the first corner that it has been to or that an earlier walk has,
    at its start at the latest for a cut that begins on such a corner, and after
    ``length`` steps (w + h times 4) in any case. side low_x lies between (x - 1, y)
    and (x, y), low_y between (x, y - 1) and (x, y).

    Walks are drawn in full, then cut: a round ends those walks all of whose earlier
    walks that they might meet have been ended.
    """
    walked = paths(maps, w, h, cuts, length or 4 * (w + h), alpha, seed)
    own = Window.partitionBy("map_id", "walk", "x", "y").orderBy("step")
    again = walked.withColumn("visit", F.row_number().over(own))
    until = again.groupBy("map_id", "walk").agg(F.min(F.when(F.col("visit") > 1, F.col("step"))).alias("until"))
    open_ = staged(again.join(until, ["map_id", "walk"]).where(F.coalesce(F.col("step") <= F.col("until"), F.lit(True))).select("map_id", "walk", "step", "x", "y"), "walks")
    # The two ways of a cut share their first corner, which ends neither.
    spots = open_.groupBy("map_id", "walk", "x", "y").agg(F.min("step").alias("step"))
    other = spots.select("map_id", "x", "y", F.col("walk").alias("first"), F.col("step").alias("there"))
    meets = spots.join(other, ["map_id", "x", "y"]).where((F.col("first") < F.col("walk")) & ~((F.floor(F.col("first") / 2) == F.floor(F.col("walk") / 2)) & (F.col("step") == 0) & (F.col("there") == 0)))
    meets = staged(meets.select("map_id", "walk", "step", "first", "there"), "meets")
    names, ends = staged(open_.select("map_id", "walk").distinct(), "walk-names"), None
    while True:
        left = names if ends is None else names.join(ends, ["map_id", "walk"], "left_anti")
        if not left.head(1):
            break
        waits = meets.join(left.select("map_id", F.col("walk").alias("first")), ["map_id", "first"], "left_semi").select("map_id", "walk").distinct()
        ready = left.join(waits, ["map_id", "walk"], "left_anti")
        hit = meets.join(ready, ["map_id", "walk"], "left_semi")
        if ends is not None:  # an earlier walk is met only where it has come before its own end
            hit = hit.join(ends.select("map_id", F.col("walk").alias("first"), F.col("end").alias("last")), ["map_id", "first"]).where(F.col("last").isNull() | (F.col("there") <= F.col("last")))
        found = ready.join(hit.groupBy("map_id", "walk").agg(F.min("step").alias("end")), ["map_id", "walk"], "left").select("map_id", "walk", "end")
        ends = staged(found if ends is None else ends.unionByName(found), "walk-ends")
    # A cut that begins on an earlier walk is none, in neither way.
    kept = open_.join(ends, ["map_id", "walk"]).where(F.col("end").isNull() | (F.col("step") <= F.col("end")))
    line = Window.partitionBy("map_id", "walk").orderBy("step")
    steps = kept.withColumn("nx", F.lead("x").over(line)).withColumn("ny", F.lead("y").over(line)).where("nx is not null")
    ahead = F.when(F.col("x") != F.col("nx"), wrap(F.col("x") + 1, w) == F.col("nx")).otherwise(wrap(F.col("y") + 1, h) == F.col("ny"))
    low = lambda c: F.when(ahead, F.col(c)).otherwise(F.col("n" + c))
    side = F.when(F.col("x") != F.col("nx"), "low_y").otherwise("low_x")
    sides = steps.select("map_id", low("x").alias("x"), low("y").alias("y"), side.alias("side"), (F.floor(F.col("walk") / 2) + 1).cast("long").alias("cut"))
    return sides.groupBy("map_id", "x", "y", "side").agg(F.min("cut").alias("cut"))
