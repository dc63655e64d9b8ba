"""Exact Voronoi cells, clipped to a square, by folding bisector half-planes over near sites.

Most cells are cut in tasks of a tile each, by the sites of the tiles around it, the
nearest first, and are final when no site beyond those can reach them. What is left,
as in clusters or along wide gaps, goes through a tree of all sites (sitetree): a cell
is final when each of its vertices has no site nearer than its own; where one has, the
nearer sites of the leaves around that vertex cut the cell in the next round. So a cell
meets few more sites than it has edges, whatever the layout: in a cluster, on a line, on
a circle. Ring vertices carry the neighbour of their outgoing edge (-1: the square), so adjacency is
a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.sitetree import SiteTree
from tessella.plans.stage import staged

RING = "array<struct<x:double,y:double,e:bigint>>"
SITES = "array<struct<site_id:bigint,sx:double,sy:double>>"
#: Mean sites of a tile in the passes over tiles, and most of a tile that is looked at.
TILES, CROWD = (48, 256), 2048


def _plane(x, y, s):
    """The half-plane of points that are nearer to (x, y) than to a site, the nearest site first."""
    a, b = s["sx"] - x, s["sy"] - y
    c = (s["sx"] * s["sx"] + s["sy"] * s["sy"] - x * x - y * y) / 2
    return F.struct((a * a + b * b).alias("d"), s["site_id"].alias("n"), a.alias("a"), b.alias("b"), c.alias("c"))


def _clip(ring, s):
    """The ring cut by a*x + b*y <= c; s has a, b, c and the neighbour's id n."""

    def inside(p):
        return s["a"] * p["x"] + s["b"] * p["y"] <= s["c"]

    def cross(p, q, e):
        d = s["a"] * (q["x"] - p["x"]) + s["b"] * (q["y"] - p["y"])
        t = F.try_divide(s["c"] - s["a"] * p["x"] - s["b"] * p["y"], d)
        return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"), e.alias("e"))

    def step(i):
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        empty = F.array().cast(RING)
        leave = F.array(p, cross(p, q, s["n"])).cast(RING)
        enter = F.array(cross(p, q, p["e"])).cast(RING)
        return F.when(inside(p), F.when(inside(q), F.array(p).cast(RING)).otherwise(leave)).otherwise(F.when(inside(q), enter).otherwise(empty))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), step))
    return F.when(F.size(ring) == 0, ring).otherwise(cut).cast(RING)


def _by_tree(own: DataFrame, size: float, box: tuple[float, float, float, float], todo: DataFrame, state: DataFrame) -> DataFrame:
    """(site_id, sx, sy, ring) of the sites to do, from what state (ring, met) has of them, by the tree of all sites."""
    x0, y0, x1, y1 = box
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(-1).cast("long").alias("e")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]).cast(RING)
    tree = SiteTree(own, size)
    begun = todo.join(state.select("site_id", "ring", "met"), "site_id", "left").join(tree.mates().withColumnRenamed("sites", "add"), "site_id", "left")
    state = staged(begun.withColumns({"ring": F.coalesce("ring", square), "met": F.coalesce("met", F.array(F.col("site_id")))}), "cells")
    squared = lambda px, py, qx, qy: (px - qx) * (px - qx) + (py - qy) * (py - qy)
    done = None
    while True:
        new = F.filter(F.coalesce("add", F.array().cast(SITES)), lambda s: ~F.array_contains("met", s["site_id"]))
        planes = F.array_sort(F.transform(new, lambda s: _plane(F.col("sx"), F.col("sy"), s)))
        cut = state.withColumn("planes", planes).withColumn("ring", F.aggregate("planes", F.col("ring"), _clip)).withColumn("met", F.array_union("met", F.transform("planes", lambda p: p["n"])))
        state = staged(cut.select("site_id", "sx", "sy", "ring", "met"), "cells")
        corners = state.select("site_id", "sx", "sy", "met", F.posexplode("ring").alias("at", "p")).select("site_id", "met", "at", F.col("p.x").alias("px"), F.col("p.y").alias("py"), "sx", "sy")
        # A site that the cell has met has cut it: what is nearer by a rounding error is no reason to cut again.
        reach = F.greatest(F.lit(0.0), F.sqrt(squared(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"))) - 1e-12 * size)
        found = tree.nearest(corners.withColumn("reach", reach * reach), ["site_id", "at"], "px", "py", "reach")
        new = F.filter("closer", lambda s: ~F.array_contains("met", s["site_id"]))
        more = found.select("site_id", F.explode(new).alias("s")).groupBy("site_id").agg(F.collect_set(F.struct("s.site_id", "s.sx", "s.sy")).alias("add"))
        more = staged(more, "cuts")
        good = state.join(more.select("site_id"), "site_id", "left_anti").select("site_id", "sx", "sy", "ring")
        done = good if done is None else done.unionByName(good)
        if not more.head(1):
            break
        state = state.join(more, "site_id")

    return done


def _near(todo: DataFrame, sites: DataFrame, size: float, parts: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(site_id, sx, sy, ring, met, sure) of the sites to do, each cell cut by the sites of its own and the eight tiles around it, the nearest first.

    A cell is sure if all sites within twice the way to its farthest vertex were
    among them. Tiles with more than CROWD sites take part in nothing; cells beside
    them are not sure, those in them have no row.
    """
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col(c) * (parts / size)))).cast("long")
    own = F.lit(True)
    tiled = sites.select("site_id", "sx", "sy", at("sx").alias("tx"), at("sy").alias("ty"))
    if todo is not sites:
        tiled, own = tiled.join(todo.select("site_id", own.alias("own")), "site_id", "left"), F.coalesce("own", F.lit(False))
    tiled = tiled.withColumn("own", own)
    full = staged(tiled.groupBy("tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("tx", "ty"), "crowded")
    # Crowded tiles are told to their neighbours as one row without a site.
    tiled = tiled.join(full, ["tx", "ty"], "left_anti").unionByName(full, allowMissingColumns=True)
    steps = F.explode(F.array(*[F.struct((F.col("tx") + i).alias("ox"), (F.col("ty") + j).alias("oy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    here = F.col("own") & (F.col("tx") == F.col("ox")) & (F.col("ty") == F.col("oy"))
    asked = tiled.select("*", steps).select("site_id", "sx", "sy", "own", "tx", "ty", "o.ox", "o.oy").select("ox", "oy", "site_id", "sx", "sy", here.alias("own"))
    if todo is not sites:
        asked = asked.join(tiled.where("own").select(F.col("tx").alias("ox"), F.col("ty").alias("oy")).distinct(), ["ox", "oy"])
    side, corners, infinite = size / parts, [(float(x), float(y), -1) for x, y in ((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))], float("inf")

    def cut(key, table):
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        ox, oy = (k.as_py() for k in key)
        whole = not table.column("site_id").null_count
        table = table.filter(table.column("site_id").is_valid())
        ids, sx, sy, own = (table.column(c).to_numpy() for c in ("site_id", "sx", "sy", "own"))
        # Beyond the tiles at the rim there are no sites.
        lo_x, hi_x = ((ox - 1) * side if ox > 1 else -infinite), ((ox + 2) * side if ox + 2 < parts else infinite)
        lo_y, hi_y = ((oy - 1) * side if oy > 1 else -infinite), ((oy + 2) * side if oy + 2 < parts else infinite)
        out = []
        for k in np.flatnonzero(own):
            x, y = float(sx[k]), float(sy[k])
            a, b = sx - x, sy - y
            far = a * a + b * b
            c = (sx * sx + sy * sy - x * x - y * y) / 2
            order = np.lexsort((ids, far))
            ring, met = list(corners), [int(ids[k])]
            reach = max((p - x) * (p - x) + (q - y) * (q - y) for p, q, _ in ring)
            for i, d, u, v, w in chain.from_iterable(zip(*(t[order[at : at + 32]].tolist() for t in (ids, far, a, b, c))) for at in range(0, len(order), 32)):
                if not ring or d > 4.000001 * reach:
                    break
                if d == 0:
                    continue  # itself
                met.append(i)
                off = [u * p + v * q - w for p, q, _ in ring]
                if max(off) <= 0:
                    continue
                new, n = [], len(ring)
                for j, (p, q, e) in enumerate(ring):
                    p2, q2, _ = ring[(j + 1) % n]
                    inner, after = off[j] <= 0, off[(j + 1) % n] <= 0
                    if inner:
                        new.append((p, q, e))
                    if inner != after:
                        run = u * (p2 - p) + v * (q2 - q)
                        t = (w - u * p - v * q) / run if run else 0.0
                        new.append((p + t * (p2 - p), q + t * (q2 - q), i if inner else e))
                ring = new
                reach = max(((p - x) * (p - x) + (q - y) * (q - y) for p, q, _ in ring), default=0.0)
            clear = min(x - lo_x, hi_x - x, y - lo_y, hi_y - y)
            sure = not ring or (whole and (clear == infinite or (clear > 0 and 4.000001 * reach < clear * clear)))
            out.append((int(ids[k]), x, y, [{"x": p, "y": q, "e": e} for p, q, e in ring], met, sure))
        columns = list(zip(*out)) or [[]] * 6
        point = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("e", pa.int64())])
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(point), pa.list_(pa.int64()), pa.bool_())
        return pa.table({n: pa.array(list(v), t) for n, v, t in zip(("site_id", "sx", "sy", "ring", "met", "sure"), columns, kinds)})

    return asked.groupBy("ox", "oy").applyInArrow(cut, f"site_id bigint, sx double, sy double, ring {RING}, met array<bigint>, sure boolean")


def cells(sites: DataFrame, size: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """sites (site_id, sx, sy) -> (site_id, sx, sy, ring) in the square [0, size], or in a box (x0, y0, x1, y1) of it.

    Of sites on one spot the lowest id has the cell. Edges shorter than 1e-9 are dropped.
    """
    own = sites.groupBy("sx", "sy").agg(F.min("site_id").alias("site_id")).select("site_id", F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    own = staged(own)
    box = tuple(map(float, box or (0.0, 0.0, size, size)))
    todo, done, state = own, None, None
    for per in TILES:
        found = staged(_near(todo, own, size, max(1, math.ceil(math.sqrt(own.count() / per))), box), "near")
        good = found.where("sure").select("site_id", "sx", "sy", "ring")
        done = good if done is None else done.unionByName(good)
        todo = own.join(done.select("site_id"), "site_id", "left_anti")
        state = found if state is None else state.join(found.select("site_id"), "site_id", "left_anti").unionByName(found)
        if not todo.head(1):
            break
    else:
        # Crowded places, and cells that reach farther than the tiles around them.
        done = done.unionByName(_by_tree(own, size, box, todo, state))

    def long_enough(p, i):
        q = F.get(F.col("ring"), (i + 1) % F.size("ring"))
        return F.hypot(q["x"] - p["x"], q["y"] - p["y"]) > 1e-9

    return done.withColumn("ring", F.filter("ring", long_enough)).where(F.size("ring") > 2)


def extent(rings: DataFrame, lo: float, hi: float) -> tuple[float, float, float, float] | None:
    """(x0, y0, x1, y1) of the vertices that are not on the border of the square [lo, hi]; None without any."""
    p = rings.select(F.explode("ring").alias("p")).select("p.x", "p.y").where((F.col("x") > lo) & (F.col("x") < hi) & (F.col("y") > lo) & (F.col("y") < hi))
    found = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if found[0] is None else tuple(found)


def bounded(sites: DataFrame, size: float) -> DataFrame:
    """Cells that end at the extent of the diagram's own vertices instead of the square."""
    box = extent(staged(cells(sites, size)), 0.0, size)
    return cells(sites, size, box)


def region_graph(rings: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of cells that share an edge."""
    pairs = rings.select("site_id", F.explode("ring.e").alias("e")).where("e >= 0")
    return pairs.select(F.least("site_id", "e").alias("a"), F.greatest("site_id", "e").alias("b")).distinct()


def vertex_graph(rings: DataFrame, digits: int = 6) -> DataFrame:
    """Distinct undirected edges (x1, y1, x2, y2) between ring vertices, rounded so that cells agree."""
    at = F.posexplode("ring").alias("i", "p")
    e = rings.select("ring", at).select(F.col("p").alias("p"), F.get("ring", (F.col("i") + 1) % F.size("ring")).alias("q"))
    r = lambda c: F.round(F.col(c), digits) + 0.0
    a, b = F.struct(r("p.x").alias("x"), r("p.y").alias("y")), F.struct(r("q.x").alias("x"), r("q.y").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return e.select(lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2")).where("x1 <> x2 or y1 <> y2").distinct()


def centroids(rings: DataFrame) -> DataFrame:
    """(site_id, area, cx, cy): shoelace centroid of each cell."""
    edge = rings.select("site_id", "ring", F.posexplode("ring").alias("i", "p")).select("site_id", "p", F.get("ring", (F.col("i") + 1) % F.size("ring")).alias("q"))
    k = F.col("p.x") * F.col("q.y") - F.col("q.x") * F.col("p.y")
    s = edge.groupBy("site_id").agg(F.sum(k).alias("k"), F.sum((F.col("p.x") + F.col("q.x")) * k).alias("x"), F.sum((F.col("p.y") + F.col("q.y")) * k).alias("y"))
    return s.select("site_id", (F.abs("k") / 2).alias("area"), (F.col("x") / (3 * F.col("k"))).alias("cx"), (F.col("y") / (3 * F.col("k"))).alias("cy"))
