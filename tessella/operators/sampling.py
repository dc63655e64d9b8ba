"""Poisson-disk sampling: bucketed distance joins, the lexicographic maximal independent set, and dart throwing from an active front."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.plans.stage import as_of, drop, running_sum, staged

#: Most points that travel to all tasks, and most of a bucket that are sorted into one block.
FEW, BLOCK = 1 << 12, 1 << 12


def close_pairs(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(id, other): points (id, px, py) and others of another id strictly nearer than radius, met by bucket.

    A few others travel to all tasks. More are sorted with the points by bucket, those
    of crowded buckets in blocks, so that a task holds one block and no bucket is one task's.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    right = others.select(F.col("id").alias("other"), F.col("px").alias("qx"), F.col("py").alias("qy"), cell("px").alias("bx"), cell("py").alias("by"))
    window = F.explode(F.array(*[F.struct((cell("px") + i).alias("bx"), (cell("py") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b")
    left = points.select("id", "px", "py", window).select("id", "px", "py", "b.bx", "b.by")
    key = ["bx", "by"]
    if others.count() <= FEW:
        right = F.broadcast(right)
    else:
        crowded = staged(right.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "crowded")
        if crowded.head(1):
            blocks = F.coalesce("blocks", F.lit(1))
            left = left.join(F.broadcast(crowded), key, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            right = right.join(F.broadcast(crowded), key, "left").withColumn("block", F.pmod(F.xxhash64("other"), blocks))
            key = [*key, "block"]
        right = right.hint("merge")
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    return left.join(right, key).where((dx * dx + dy * dy < radius * radius) & (F.col("id") != F.col("other"))).select("id", "other")


def poisson_disk(points: DataFrame, radius: float) -> DataFrame:
    """The points that dart throwing in the order of id keeps: none nearer than radius, and none can be added.

    Points of one place are thrown once; those without a place are kept. Cells are so
    small that all points of one are near each other, so a round looks at the first
    point of each cell alone: it is kept if none of the points left around it is
    earlier, and what is near a kept one goes. Each point meets the first ones of the
    25 cells around its own; pairs of points are never listed, however dense they are.
    """
    side, square = radius / math.sqrt(2), radius * radius
    own = points.groupBy("px", "py").agg(F.min("id").alias("id")).select("id", "px", "py")
    live = staged(own.withColumns({c: F.floor(F.col(f"p{c[1]}") / side) for c in ("cx", "cy")}), "points")
    kept = live.where("cx is null or cy is null").select("id", "px", "py")
    left, read = live.where("cx is not null and cy is not null"), live
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-2, 3) for j in range(-2, 3)])).alias("c")

    def met(firsts: DataFrame, few: bool) -> DataFrame:
        """A row of firsts (id, px, py, cx, cy) as (first, qx, qy) for each cell around its own."""
        spread = firsts.select(F.col("id").alias("first"), F.col("px").alias("qx"), F.col("py").alias("qy"), around).select("first", "qx", "qy", "c.cx", "c.cy")
        return F.broadcast(spread) if few else spread.hint("merge")

    def on(spread: DataFrame, rows: DataFrame):
        dx, dy = rows["px"] - spread["qx"], rows["py"] - spread["qy"]
        return (rows["cx"] == spread["cx"]) & (rows["cy"] == spread["cy"]), dx * dx + dy * dy < square

    while n := left.count():
        first = F.min(F.struct("id", "px", "py"))
        firsts = staged(left.groupBy("cx", "cy").agg(first.alias("p")).select("p.*", "cx", "cy"), "firsts")
        few = n <= FEW or firsts.count() <= FEW
        spread = met(firsts, few)
        cell, near = on(spread, left)
        late = left.join(spread, cell & near & (left["id"] < spread["first"])).select(spread["first"].alias("id")).distinct()
        new = staged(firsts.join(late, "id", "left_anti").select("id", "px", "py", "cx", "cy"), "kept")
        spread = met(new, few)
        cell, near = on(spread, left)
        rest = staged(left.join(spread, cell & (near | (left["id"] == spread["first"])), "left_anti"), "points")
        kept = kept.unionByName(new.select("id", "px", "py"))
        drop(firsts, *([read] if read is not live else []))
        left = read = rest
    return kept


def thrown(active: DataFrame, radius: float, tries: int, stream: int) -> DataFrame:
    """(parent, id, px, py): tries candidates for each active point (id, px, py), uniform in the ring from radius to twice that, inside the unit square.

    id is a draw of 63 bits: the candidates' priority, the least first.
    """
    k, key = F.col("k"), F.col("parent")
    each = active.select(F.col("id").alias("parent"), F.col("px").alias("ox"), F.col("py").alias("oy"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    u, v = (draws.uniform(key, k * 4 + (stream * tries * 4 + j)) for j in (0, 1))
    name = draws.bits(key, k * 4 + (stream * tries * 4 + 2)) * F.lit(1 << 31) + F.shiftright(draws.bits(key, k * 4 + (stream * tries * 4 + 3)), 1)
    far = each.withColumns({"d": radius * F.sqrt(1 + 3 * u), "way": 2 * F.pi() * v})
    at = far.select("parent", name.alias("id"), (F.col("ox") + F.col("d") * F.cos("way")).alias("px"), (F.col("oy") + F.col("d") * F.sin("way")).alias("py"))
    return at.where(F.col("px").between(0, 1) & F.col("py").between(0, 1))


def fill(start: DataFrame, radius: float, tries: int = 30, seed: int = 1) -> DataFrame:
    """start (id, px, py) -> (id, px, py): points of the unit square, none nearer than radius, grown from those of start.

    The start's own points are thrown first, in the order of id, ids not negative. Then
    all active points throw at once into the rings around them. Candidates too near to
    a point that is kept are lost; of candidates too near to each other the one of the
    least draw may stay, if none before it is near, and the others' points throw
    again. A point rests when all its tries of a round are too near to kept points;
    the square is full when all rest. Without a start nothing grows.
    """
    kept = staged(poisson_disk(start.where(F.col("px").between(0, 1) & F.col("py").between(0, 1)), radius), "kept")
    active, stream = kept, seed << 10
    while active.head(1):
        found = staged(thrown(active, radius, tries, stream), "thrown")
        near = close_pairs(found.select("id", "px", "py"), kept, radius).select("id").distinct()
        free = staged(found.join(near, "id", "left_anti"), "free")
        beaten = close_pairs(free.select("id", "px", "py"), free.select("id", "px", "py"), radius).where("other < id").select("id").distinct()
        new = staged(free.join(beaten, "id", "left_anti").select("id", "px", "py"), "new")
        tired = free.select(F.col("parent").alias("id")).distinct()
        again = staged(active.join(tired, "id", "left_semi").unionByName(new), "active")
        drop(found, free, *([active] if active is not kept else []))
        kept, active, stream = kept.unionByName(new), again, stream + 1
    return kept


def fill_grid(start: DataFrame, size: int, radius: float, tries: int = 30, seed: int = 1) -> DataFrame:
    """(id, x, y): cells of a grid of that size, from the unit square's fill, scaled and cut to whole numbers; so some are nearer than radius by under the root of 2."""
    return fill(start, radius / size, tries, seed).select("id", *(F.floor(F.col(f"p{c}") * size).cast("long").alias(c) for c in "xy"))


def annulus(candidates: DataFrame, ox: float, oy: float, r1: float, r2: float) -> DataFrame:
    """Candidates (px, py) strictly between two radii of an origin, inside the unit square."""
    d2 = (F.col("px") - ox) * (F.col("px") - ox) + (F.col("py") - oy) * (F.col("py") - oy)
    return candidates.where((d2 > r1 * r1) & (d2 < r2 * r2) & F.col("px").between(0, 1) & F.col("py").between(0, 1))


def weighted_picks(items: DataFrame, picks: DataFrame, group: str = "grp") -> DataFrame:
    """items (group, id, weight), picks (group, pick, u) -> picks with id: the item whose share of its group's weight holds u, from 0 to 1.

    Shares stand in the order of id; weights are whole, those of 0 and below have no
    share. Groups of any size: running sums and the search in them go over ranges.
    """
    own = items.where(F.col("weight") > 0).select(group, "id", F.col("weight").cast("long").alias("weight"))
    totals = staged(own.groupBy(group).agg(F.sum("weight").alias("total")), "totals")
    summed = running_sum(own, [group, "id"], "weight", "before")
    first = summed.groupBy(group).agg(F.min("before").alias("first"))
    marks = summed.join(first, group).select(group, (F.col("before") - F.col("first")).cast("double").alias("place"), "id")
    aimed = picks.join(totals, group).withColumn("place", F.col("u") * F.col("total")).drop("total")
    return as_of(aimed, marks, "place", "id", (group,)).drop("place")
