"""Nearest-site joins on a torus: label rasters, weighted and hierarchical.

Many sites are found through an index of tiles: a quad-tree over the area, whose
leaves hold the sites that can be nearest to some point of the leaf. A tile's sites
are those of its parent that its bounds leave: a site goes when even the nearest
point of the tile would find another site nearer than this one. Only tiles with more
than LEAF sites are split, down to a few cells; from far away a cluster or a line has
many sites at nearly one distance, and cells there meet more than LEAF of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import sq_torus
from tessella.plans.stage import staged

#: Up to so many pairs of a cell and a site all sites travel as one array; beyond, they are found through tiles.
ARRAY_PAIRS, ARRAY_SITES = 1 << 22, 2048
#: Most sites of a tile that is not split, and the first level that is looked at.
LEAF, FIRST_LEVEL = 16, 2


def nearest(cells: DataFrame, sites: DataFrame, w: int, h: int, weight: str | None = None) -> DataFrame:
    """cells (x, y) with label: the site (site_id, sx, sy) of least distance, lowest id on ties.

    A cell on which sites stand takes the highest id of those. With a weight
    column, of positive numbers, the distance is weight times the Euclidean one on
    the torus, and the lowest id wins every tie.
    """
    n = sites.count()
    if n == 0:
        return cells.drop("label").withColumn("label", F.lit(None).cast("long"))
    if n <= ARRAY_SITES and n * cells.count() <= ARRAY_PAIRS:
        return _by_array(cells, sites, w, h, weight)
    cost = lambda s, x, y: _cost(s, w, h, weight, x, y)
    finest = max(FIRST_LEVEL, math.ceil(math.log2(max(w, h))) - 1)  # tiles of two by two cells
    found = lookup(cells.drop("label"), Tiles(sites, float(w), float(h), finest, weight), "x", "y", cost)
    return found.select(*cells.drop("label").columns, F.col("best.id").alias("label"))


def _cost(s, w, h, weight, x="x", y="y"):
    d2 = sq_torus(F.col(x), F.col(y), s["sx"], s["sy"], w, h)
    # On a site the higher id wins: it is the later writer.
    tie = F.when(d2 == 0, -s["site_id"]).otherwise(s["site_id"]) if not weight else s["site_id"]
    d = s[weight] * F.sqrt(d2.cast("double")) if weight else d2
    return F.struct(d.alias("d"), tie.alias("tie"), s["site_id"].alias("id"))


def _by_array(cells, sites, w, h, weight):
    cols = ["site_id", "sx", "sy", *([weight] if weight else [])]
    every = sites.agg(F.collect_list(F.struct(*cols)).alias("s"))
    best = F.array_min(F.transform("s", lambda s: _cost(s, w, h, weight)))
    return cells.crossJoin(F.broadcast(every)).select(*cells.columns, best["id"].alias("label"))


class Tiles:
    """The index of sites (site_id, sx, sy) over the area from (0, 0) to (w, h): ``leaves`` (level, tx, ty, sites) and ``rest``.

    Distances are those on the torus. rest has the sites (level, tx, ty, site_id, sx,
    sy) of tiles of the last level that still hold more than LEAF, as those around the
    centre of a circle of sites do; it is None without any. Of sites on one spot only
    those stay that can win.
    """

    def __init__(self, sites: DataFrame, w: float, h: float, last_level: int, weight: str | None = None):
        self.w, self.h, self.weight = w, h, weight
        self.columns = ["site_id", "sx", "sy", *([weight] if weight else [])]
        own = staged(self._spots(sites), "sites")
        leaves, self.rest, self.levels, tile = None, None, [], ["tx", "ty"]
        steps = F.sequence(F.lit(0).cast("long"), F.lit((1 << FIRST_LEVEL) - 1).cast("long"))
        now = own.withColumn("tx", F.explode(steps)).withColumn("ty", F.explode(steps))
        for level in range(FIRST_LEVEL, last_level + 1):
            left = staged(self._pruned(now, level), "tiles")
            counts = left.groupBy(*tile).agg(F.count("*").alias("n"))
            few = left.join(counts.where(F.col("n") <= LEAF).select(*tile), tile).groupBy(*tile).agg(F.collect_list(F.struct(*self.columns)).alias("sites"))
            few = few.select(F.lit(level).alias("level"), *tile, "sites")
            leaves = few if leaves is None else leaves.unionByName(few)
            self.levels.append(level)
            crowded = counts.where(F.col("n") > LEAF).select(*tile)
            if not crowded.head(1):
                break
            now = left.join(crowded, tile)
            if level == last_level:
                self.rest = now.withColumn("level", F.lit(level))
            half = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
            now = now.withColumn("tx", half("tx")).withColumn("ty", half("ty"))
        self.leaves = staged(leaves, "leaves")

    def _spots(self, sites: DataFrame) -> DataFrame:
        """Of a spot the lowest id and, where the highest can win or weights differ, one more."""
        first = F.min(F.struct(self.weight, "site_id")) if self.weight else F.max(F.struct("site_id"))
        lowest = F.min(F.struct("site_id", *([self.weight] if self.weight else [])))
        both = sites.groupBy("sx", "sy").agg(F.array_distinct(F.array(*(F.struct(c["site_id"].alias("site_id"), *([c[self.weight].alias(self.weight)] if self.weight else [])) for c in (first, lowest)))).alias("s"))
        return both.select("sx", "sy", F.explode("s").alias("s")).select(*(F.col(c) if c in ("sx", "sy") else F.col(f"s.{c}") for c in self.columns))

    def _pruned(self, rows: DataFrame, level: int) -> DataFrame:
        """Of rows of sites and tiles those that the tiles' bounds leave."""
        parts = 1 << level
        apart = lambda d, size: F.least(d, F.lit(size) - d)
        off = lambda at, site, size: apart(F.abs((F.col(at) + 0.5) * (size / parts) - F.col(site).cast("double")), size)
        d = F.hypot(off("tx", "sx", self.w), off("ty", "sy", self.h))
        r = math.hypot(self.w / parts, self.h / parts) / 2 * (1 + 1e-9)
        times = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        bound = rows.withColumns({"_low": times * F.greatest(F.lit(0.0), d - r), "_high": times * (d + r)})
        least = bound.groupBy("tx", "ty").agg(F.min("_high").alias("_least"))
        return bound.join(least, ["tx", "ty"]).where(F.col("_low") <= F.col("_least") * (1 + 1e-9)).select("tx", "ty", *self.columns)

    def tile(self, x: str, y: str, level) -> list[Column]:
        """The tile of a point at a level, a number or a column."""
        parts = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(float(1 << level))
        at = lambda c, size: F.greatest(F.lit(0), F.least(parts - 1, F.floor(F.col(c) * parts / size))).cast("long")
        return [at(x, self.w).alias("tx"), at(y, self.h).alias("ty")]


def lookup(points: DataFrame, tiles: Tiles, x: str, y: str, cost) -> DataFrame:
    """points with ``best``: the least cost(site, x, y) among the sites of their tile; points lie in the tiles' area."""
    levels = F.explode(F.array(*[F.lit(k) for k in tiles.levels])).alias("level")
    looked = points.select("*", levels).select("*", *tiles.tile(x, y, F.col("level")))
    out = looked.join(tiles.leaves, ["level", "tx", "ty"]).select(*points.columns, F.array_min(F.transform("sites", lambda s: cost(s, x, y))).alias("best"))
    if tiles.rest is None:
        return out
    last = points.select("*", F.lit(tiles.levels[-1]).alias("level"), *tiles.tile(x, y, tiles.levels[-1])).join(tiles.rest, ["level", "tx", "ty"])
    own = {c: F.col(c) for c in tiles.columns}
    return out.unionByName(last.groupBy(*points.columns).agg(F.min(cost(own, x, y)).alias("best")))


def _by_bucket(cells, sites, w, h, n):
    """Cells look into the buckets around theirs; what is not nearer than a bucket is wide looks again, twice as wide."""
    side, done = max(1, int(math.sqrt(w * h / n) * 1.5)), None
    while True:
        bx, by = max(1, w // side), max(1, h // side)
        spot = lambda x, y: (F.least(F.floor(x / side), F.lit(bx - 1)), F.least(F.floor(y / side), F.lit(by - 1)))  # noqa: B023, E731
        sx, sy = spot(F.col("sx"), F.col("sy"))
        columns = ["site_id", "sx", "sy"]
        placed = sites.select(*columns, sx.alias("bx"), sy.alias("by"))
        cx, cy = spot(F.col("x"), F.col("y"))
        near = F.explode(F.array_distinct(F.array(*[F.struct(F.pmod(cx + i, F.lit(bx)).alias("bx"), F.pmod(cy + j, F.lit(by)).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).alias("b")
        looked = cells.select(*cells.columns, near).select(*cells.columns, "b.bx", "b.by").join(placed, ["bx", "by"], "left")
        cost = F.when(F.col("site_id").isNotNull(), _cost({c: F.col(c) for c in columns}, w, h, None))
        found = staged(looked.groupBy(*cells.columns).agg(F.min(cost).alias("best")))
        sure = (F.col("best.d") <= side * side) | F.lit(bx <= 3 and by <= 3)
        good = found.where(F.coalesce(sure, F.lit(False))).select(*cells.columns, F.col("best.id").alias("label"))
        done = good if done is None else done.unionByName(good)
        cells = found.where(~F.coalesce(sure, F.lit(False))).select(*cells.columns)
        if not cells.head(1):
            return done
        side *= 2


def balanced_weights(sites: DataFrame, value: str) -> DataFrame:
    """sites with weight: value shifted so that the least is 1."""
    low = sites.agg(F.min(value).alias("_low"))
    return sites.crossJoin(F.broadcast(low)).withColumn("weight", F.col(value) - F.col("_low") + 1.0).drop("_low")


def areas(labelled: DataFrame, ids: DataFrame) -> DataFrame:
    """(label, area, share) for each id of ids (label), empty ones included."""
    counted = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("area"))
    total = labelled.agg(F.count("*").alias("total"))
    out = ids.select("label").join(counted, "label", "left").crossJoin(F.broadcast(total))
    return out.select("label", F.coalesce("area", F.lit(0)).cast("long").alias("area"), F.round(F.coalesce("area", F.lit(0)) / F.col("total"), 6).alias("share"))


def midpoints(labelled: DataFrame) -> DataFrame:
    """(label, cells, sum_x, sum_y, mx, my): whole midpoints of regions, in the plane."""
    sums = labelled.groupBy("label").agg(F.count("*").alias("cells"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    return with_midpoint(sums)


def with_midpoint(sums: DataFrame) -> DataFrame:
    return sums.withColumn("mx", F.floor(F.col("sum_x") / F.col("cells")).cast("long")).withColumn("my", F.floor(F.col("sum_y") / F.col("cells")).cast("long"))


def nested(labelled: DataFrame, levels: list[DataFrame], w: int, h: int) -> tuple[DataFrame, DataFrame]:
    """Regions joined to coarser sites, level by level: the raster's final labels, and the last level's sums.

    The raster is read once for sums and once to relabel; levels roll sums up.
    """
    sums = midpoints(labelled)
    mapping = sums.select(F.col("label").alias("first"), F.col("label").alias("now"))
    for sites in levels:
        spots = sums.withColumnsRenamed({"label": "fine", "mx": "x", "my": "y"})
        moved = nearest(spots, sites, w, h).withColumnsRenamed({"label": "coarse", "fine": "label"})
        mapping = mapping.join(moved.select(F.col("label").alias("now"), "coarse"), "now").select("first", F.col("coarse").alias("now"))
        sums = with_midpoint(moved.groupBy(F.col("coarse").alias("label")).agg(F.sum("cells").alias("cells"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y")))
    out = labelled.join(mapping.select(F.col("first").alias("label"), F.col("now").alias("region")), "label")
    return out.select("x", "y", F.col("region").alias("label")), sums
