"""Areas between borders, regions merged until so many remain, and the tree of all merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.draws import bits
from tessella.operators.components import TILE, components, dense, parts
from tessella.plans.stage import drop, staged


def areas_between(cells: DataFrame, sides: DataFrame, w: int, h: int, torus: bool = True, tile: int = TILE) -> DataFrame:
    """cells (map_id, x, y), border sides (map_id, x, y, side) -> (map_id, x, y, region).

    side low_x is the border to (x - 1, y), low_y that to (x, y - 1). Regions of
    a map are numbered from 1 by their least cell. Tiles are labelled whole, then
    joined across their borders. Without torus, cells at opposite ends do not meet.
    """
    wall = sides.select("map_id", "x", "y", "side").distinct().groupBy("map_id", "x", "y").agg(F.max(F.col("side") == "low_x").alias("wx"), F.max(F.col("side") == "low_y").alias("wy"))
    cut = cells.join(wall, ["map_id", "x", "y"], "left").fillna(False, ["wx", "wy"]).withColumn("label", F.lit(0))
    rooted = staged(parts(cut, w, h, torus, tile), "roots")
    numbered = staged(rooted.join(dense(rooted, "root"), F.col("root") == F.col("old")).select("map_id", "x", "y", "new"))
    least = numbered.groupBy("map_id").agg(F.min("new").alias("least"))
    return numbered.join(least, "map_id").select("map_id", "x", "y", (F.col("new") - F.col("least") + 1).alias("region"))


def spanning(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, weight), weights distinct -> those of the least spanning forest.

    Rounds: every part takes its border of least weight; borders so taken hold no
    cycle. Parts at least halve in number each time.
    """
    state = staged(pairs.select(F.col("a").alias("label")).unionByName(pairs.select(F.col("b").alias("label"))).distinct().withColumn("part", F.col("label")))
    taken = None
    while True:
        one, two = (state.select(F.col("label").alias(c), F.col("part").alias(r)) for c, r in (("a", "p"), ("b", "q")))
        live = pairs.join(one, "a").join(two, "b").where("p <> q")
        edge = F.struct("weight", "a", "b").alias("x")
        ends = live.select(F.col("p").alias("part"), F.struct(edge, F.col("q").alias("to")).alias("y")).unionByName(live.select(F.col("q").alias("part"), F.struct(edge, F.col("p").alias("to")).alias("y")))
        picked = staged(ends.groupBy("part").agg(F.min("y").alias("y")).select("part", "y.x", "y.to"))
        if not picked.head(1):
            return taken if taken is not None else pairs.where("false")
        new = picked.select("x.*").distinct().select("a", "b", "weight")
        taken = new if taken is None else taken.unionByName(new)
        # Every part points at one other; only two that picked one border point at each other, and the lower one is the root.
        back = picked.select(F.col("part").alias("to"), F.col("to").alias("back"))
        up = picked.join(back, "to").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("to"))
        while True:
            for _ in range(3):
                up = up.join(up.select(F.col("part").alias("to"), F.col("to").alias("over")), "to").select("part", F.col("over").alias("to"), (F.col("over") != F.col("to")).alias("moved"))
            up = staged(up)
            if not up.where("moved").head(1):
                break
            up = up.drop("moved")
        state = staged(state.join(up.select("part", "to"), "part", "left").select("label", F.coalesce("to", "part").alias("part")))


def border_weight(seed: int):
    """A number below 2^32 for each pair (a, b), by the portable generator."""
    return bits(F.col("a") * 1_000_003 + F.col("b"), seed)


def merge_regions(ids: DataFrame, pairs: DataFrame, regions: int, seed: int = 1) -> DataFrame:
    """ids (label), adjacency pairs (a, b) -> (label, region): neighbours merged at random until so many regions remain.

    Borders go in a random order, those within a region are skipped, until enough
    regions have merged: what remains is the forest of the order's least borders
    without its last ones. Regions without a way to each other stay apart, even if
    more than asked for remain. region is 1..k.
    """
    names = ids.select("label").distinct()
    weighed = staged(pairs.select("a", "b", F.struct(border_weight(seed).alias("w"), "a", "b").alias("weight")))
    forest = staged(spanning(weighed))
    merges = max(0, names.count() - regions)
    ranked = forest.join(dense(forest, "weight"), F.col("weight") == F.col("old")).where(F.col("new") <= merges)
    found = components(ranked.select("a", "b"))
    state = staged(names.join(found.withColumnRenamed("id", "label"), "label", "left").select("label", F.coalesce("component", "label").alias("region")))
    return state.join(dense(state, "region"), F.col("region") == F.col("old")).select("label", F.col("new").alias("region"))


#: Merges that one task puts in order.
BLOCK = 4096


def merge_tree(pairs: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """adjacency pairs (a, b) -> (step, kept, gone): the merges of merge_regions() down to the last, in order.

    A region has the name of its least label; step joins the region ``gone`` to that
    of the lower name ``kept``. Each label goes once at most, so these rows are a
    forest with parents kept: regions_after() and adjacency_after() look up any number
    of merges in it. Pairs in either order and more than once are one; loops and nulls
    are ignored.

    The least spanning forest's borders, in order, are halved until a block has few
    enough for one task: the later half of each block sees the regions that the earlier
    half makes, which one search for components gives for all blocks at once.
    """
    low, high = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    single = pairs.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()
    forest = staged(spanning(staged(single.select("a", "b", F.struct(border_weight(seed).alias("w"), "a", "b").alias("weight")), "borders")), "forest")
    edges = staged(forest.join(dense(forest, "weight"), F.col("weight") == F.col("old")).select(F.col("new").alias("step"), "a", "b"), "order")
    n, size = edges.count(), block
    while size < n:
        size *= 2
    while size > block:
        within = F.floor((F.col("step") - 1) / size)
        late = (F.col("step") - 1) % size >= size // 2
        node = lambda c: F.struct(within.alias("block"), F.col(c).alias("v")).alias(c)
        early = edges.where(~late)
        names = components(early.select(node("a"), node("b")))
        moved = edges.where(late).select("step", node("a"), node("b"))
        for c in ("a", "b"):
            moved = moved.join(names.select(F.col("id").alias(c), F.col("component").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new = staged(early.unionByName(moved.select("step", F.col("a.v").alias("a"), F.col("b.v").alias("b"))), "order")
        drop(edges)
        edges, size = new, size // 2

    def joined(frame):
        frame = frame.sort_values("step")
        up: dict[int, int] = {}

        def top(v):
            while v in up:
                up[v] = up.get(up[v], up[v])
                v = up[v]
            return v

        merged = []
        for a, b in zip(frame["kept"].tolist(), frame["gone"].tolist()):
            low, high = sorted((top(a), top(b)))
            up[high] = low
            merged.append((low, high))
        frame[["kept", "gone"]] = merged
        return frame

    dealt = edges.select("step", F.col("a").alias("kept"), F.col("b").alias("gone")).groupBy(F.floor((F.col("step") - 1) / block))
    return dealt.applyInPandas(joined, "step long, kept long, gone long")


def regions_after(ids: DataFrame, tree: DataFrame, merges: list[int]) -> DataFrame:
    """ids (label), merge_tree() -> (merges, label, region): the least label of each one's region after each of some numbers of merges.

    Pointers to the next lower name are doubled, for all numbers at once; a number
    beyond the last step is the last step.
    """
    asked = ids.select(F.col("label").cast("long").alias("label")).distinct().select(F.explode(F.array(*[F.lit(k).cast("long") for k in sorted(set(merges))])).alias("merges"), "label")
    up = staged(asked.join(tree.select("step", "kept", F.col("gone").alias("label")), "label", "left").select("merges", "label", F.when(F.col("step") <= F.col("merges"), F.col("kept")).otherwise(F.col("label")).alias("region")), "pointers")
    while True:
        over = up.select("merges", F.col("label").alias("region"), F.col("region").alias("over"))
        new = staged(up.join(over, ["merges", "region"]).select("merges", "label", F.col("over").alias("region"), (F.col("over") != F.col("region")).alias("moved")), "pointers")
        drop(up)
        up = new.drop("moved")
        up._staged_path = new._staged_path
        if not new.where("moved").head(1):
            return up


def adjacency_after(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """pairs (a, b), regions_after() -> (merges, a, b): neighbours among the regions that remain, a below b."""
    one, two = (regions.select("merges" if c == "a" else F.col("merges").alias("also"), F.col("label").alias(c), F.col("region").alias("r" + c)) for c in ("a", "b"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b").where("merges = also and ra <> rb")
    return met.select("merges", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
