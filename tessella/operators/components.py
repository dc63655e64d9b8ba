"""Connected components by alternating star contraction, and what labels regions and lines with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import wrap
from tessella.plans.stage import drop, running_sum, staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (id, component): the least id reachable, for every id in an edge; loops and nulls are ignored.

    Alternating large-star and small-star contraction: every round is a handful of
    joins and grouped minima, and the stage before it goes.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        deep = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(deep.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(e)
        e = new
    ends = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends)


def dense(labels: DataFrame, column: str) -> DataFrame:
    """(old, new): ids 1..k in the order of the old ones."""
    ids = labels.select(F.col(column).alias("old")).distinct().withColumn("one", F.lit(1).cast("long"))
    return running_sum(ids, ["old"], "one", "before").select("old", (F.col("before") + 1).alias("new"))


#: Width of the square tiles that are labelled in one piece.
TILE = 128


def parts(cells: DataFrame, w: int, h: int, torus: bool = True, tile: int = TILE) -> DataFrame:
    """cells (map_id, x, y, label, wx, wy) -> (map_id, x, y, root): the least packed cell (map_id * w + x) * h + y that a cell hangs together with.

    Neighbours hang together where their labels are the same and no wall is between
    them: wx is the wall to (x - 1, y), wy that to (x, y - 1). Tiles are labelled
    whole, each in one task of bounded size; only cells at the borders of tiles meet in
    joins, and only parts that reach such a border in the search for components.
    """

    def labelled(frame):
        """A tile's cells with ``part``: the least packed cell that hangs together with a cell inside the tile."""
        import numpy as np

        x, y = frame["x"].to_numpy(np.int64), frame["y"].to_numpy(np.int64)
        label, wx, wy = frame["label"].to_numpy(), frame["wx"].to_numpy(bool), frame["wy"].to_numpy(bool)
        at = (x % tile) * tile + y % tile
        where = np.full(tile * tile, -1)
        where[at] = np.arange(len(at))
        ties = []
        for inside, wall, step in ((x % tile > 0, wx, tile), (y % tile > 0, wy, 1)):
            a = np.flatnonzero(inside & ~wall)
            b = where[at[a] - step]
            keep = (b >= 0) & (label[a] == label[b])
            ties.append((a[keep], b[keep]))
        a, b = (np.concatenate(c) for c in zip(*ties))
        order = np.argsort((x % tile) * tile + y % tile, kind="stable")  # packed cells of a tile have this order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b, root = rank[a], rank[b], np.arange(len(order))
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        packed = (frame["map_id"].to_numpy(np.int64) * w + x) * h + y
        frame["part"] = packed[order][root[rank]]
        return frame[["map_id", "x", "y", "label", "wx", "wy", "part"]]

    own = cells.select(F.col("map_id").cast("long").alias("map_id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("label").cast("long").alias("label"), "wx", "wy")
    dealt = own.groupBy("map_id", F.floor(F.col("x") / tile), F.floor(F.col("y") / tile))
    held = staged(dealt.applyInPandas(labelled, "map_id long, x long, y long, label long, wx boolean, wy boolean, part long"), "tiles")
    links = None
    for dx, dy, c, wall, size in ((1, 0, "x", "wx", w), (0, 1, "y", "wy", h)):
        edge = held.where((F.col(c) % tile == 0) & ~F.col(wall) & (F.lit(torus) | (F.col(c) > 0)))
        last = held.where((F.col(c) % tile == tile - 1) | (F.col(c) == size - 1))
        back = last.select("map_id", wrap(F.col("x") + dx, w).alias("x"), wrap(F.col("y") + dy, h).alias("y"), F.col("label").alias("other"), F.col("part").alias("b"))
        pairs = edge.join(back, ["map_id", "x", "y"]).where("label = other and part <> b").select(F.col("part").alias("a"), "b").distinct()
        links = pairs if links is None else links.unionByName(pairs)
    found = components(links)
    return held.join(found.withColumnRenamed("id", "part"), "part", "left").select("map_id", "x", "y", F.coalesce("component", "part").alias("root"))


def regions(grid: DataFrame, w: int, h: int, torus: bool = True, tile: int = TILE) -> DataFrame:
    """(x, y, region): connected cells of one label, regions numbered 1..k by their least packed cell."""
    no = F.lit(False)
    rooted = staged(parts(grid.select(F.lit(0).alias("map_id"), "x", "y", "label", no.alias("wx"), no.alias("wy")), w, h, torus, tile), "roots")
    return rooted.join(dense(rooted, "root"), F.col("root") == F.col("old")).select("x", "y", F.col("new").alias("region"))


def edge_key() -> Column:
    """A number for each unit edge (x1, y1, x2, y2) of the corner lattice: its lower corner, by rows, and its direction; for coordinates below 2^30."""
    x, y = F.least("x1", "x2").cast("long"), F.least("y1", "y2").cast("long")
    return (x * F.lit(1 << 31) + y) * 2 + (F.col("y1") == F.col("y2")).cast("long")


def label_edges(edges: DataFrame) -> DataFrame:
    """Boundary edges with ``label``: connected edges between the same two groups, numbered 1..k."""
    own = staged(edges.withColumn("id", edge_key()).withColumn("lo", F.least("group_a", "group_b")).withColumn("hi", F.greatest("group_a", "group_b")))
    ends = own.select("id", "lo", "hi", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v"))
    meet = ends.groupBy("v", "lo", "hi").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.collect_set("id").alias("ids"))
    links = meet.where("a <> b").select("a", F.explode("ids").alias("b")).where("a <> b")
    rooted = staged(own.join(components(links), "id", "left").withColumn("root", F.coalesce("component", "id")))
    named = rooted.join(dense(rooted, "root"), F.col("root") == F.col("old"))
    return named.select(F.col("new").alias("label"), "x1", "y1", "x2", "y2", "group_a", "group_b")


def polylines(edges: DataFrame, w: int, h: int) -> DataFrame:
    """(line, n_edges, closed): chains of corner-graph edges between junctions (corners of degree other than 2).

    A corner of degree 2 joins its two edges; a chain without a junction is a closed loop.
    """
    own = edges.withColumn("id", edge_key())
    at = lambda x, y: F.struct(wrap(F.col(x), w).alias("x"), wrap(F.col(y), h).alias("y")).alias("v")
    ends = staged(own.select("id", at("x1", "y1")).unionByName(own.select("id", at("x2", "y2"))))
    meet = ends.groupBy("v").agg(F.count("*").alias("degree"), F.min("id").alias("a"), F.max("id").alias("b"))
    chains = components(meet.where("degree = 2").select("a", "b"))
    edge = ends.join(meet.select("v", "degree"), "v").groupBy("id").agg(F.sum((F.col("degree") != 2).cast("int")).alias("ends"))
    named = edge.join(chains, "id", "left").groupBy(F.coalesce("component", "id").alias("line"))
    return named.agg(F.count("*").alias("n_edges"), (F.sum("ends") == 0).alias("closed"))
