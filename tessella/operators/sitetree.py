"""A quad-tree over sites in the plane, with bounded leaves, and nearest sites of points through it.

Nodes hold their sites' bounding box. A point goes down the tree level by level with
the nodes that can hold its nearest site: those whose box is not farther than the
farthest corner of some other box. From far away a cluster or a line of sites is a
few boxes, so a point meets a few leaves whatever the layout. All levels of a lookup
are one plan, whose rows stay dealt by point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.stage import staged

#: Most sites of a leaf (but at the last level), levels that are counted at once, and the last level.
LEAF, STEP, LAST = 16, 6, 30
NODE = ["level", "nx", "ny"]


class SiteTree:
    """sites (site_id, sx, sy), on distinct spots of the square [0, size]: ``nodes`` with boxes, ``leaves`` with sites, ``depth``."""

    def __init__(self, sites: DataFrame, size: float):
        at = lambda c: F.greatest(F.lit(0), F.least(F.pow(F.lit(2.0), F.col("level")) - 1, F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("level")) / size))).cast("long")
        now, nodes, leaves, self.depth = sites.select("site_id", "sx", "sy"), None, None, 0
        for base in range(0, LAST, STEP):
            rows = now.withColumn("level", F.explode(F.sequence(F.lit(base + 1), F.lit(base + STEP)))).withColumns({"nx": at("sx"), "ny": at("sy")})
            box = [f(c).alias(f"{c[1]}{k}") for c in ("sx", "sy") for k, f in ((0, F.min), (1, F.max))]
            counts = staged(rows.groupBy(*NODE).agg(F.count("*").alias("n"), *box), "counts")
            crowded = counts.where(F.col("n") > LEAF).select((F.col("level") + 1).alias("level"), F.col("nx").alias("px"), F.col("ny").alias("py"))
            below = counts.where(F.col("level") > base + 1).withColumns({"px": F.shiftright("nx", 1), "py": F.shiftright("ny", 1)}).join(crowded, ["level", "px", "py"], "left_semi").drop("px", "py")
            kept = counts.where(F.col("level") == base + 1).unionByName(below).withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == LAST)).drop("n")
            kept = staged(kept, "nodes")
            held = rows.join(kept.where("leaf").select(*NODE), NODE).groupBy(*NODE).agg(F.collect_list(F.struct("site_id", "sx", "sy")).alias("sites"))
            nodes, leaves = (new if old is None else old.unionByName(new) for old, new in ((nodes, kept), (leaves, held)))
            self.depth = kept.agg(F.max("level")).first()[0] or self.depth
            rest = kept.where((F.col("level") == base + STEP) & ~F.col("leaf")).select(*NODE)
            if not rest.head(1):
                break
            now = staged(rows.join(rest, NODE).select("site_id", "sx", "sy"), "crowded")
        self.nodes, self.leaves = nodes, staged(leaves, "leaves")

    def mates(self) -> DataFrame:
        """(site_id, sites): the sites of each site's leaf, itself included."""
        return self.leaves.select(F.explode("sites.site_id").alias("site_id"), "sites")

    def nearest(self, points: DataFrame, key: list[str], x: str, y: str, within: str | None = None) -> DataFrame:
        """points, told apart by the key, with ``best`` (d, site_id, sx, sy): squared distance and place of the nearest site, lowest id on ties.

        within: with ``closer`` too, those sites of the leaves that were looked at whose
        squared distance is below that column's; if there is any in the plane, one is
        among them. Without sites there is no row.
        """
        own, px, py = points.columns, F.col(x), F.col(y)
        rows = points.select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("nx"), F.lit(0).cast("long").alias("ny"), F.lit(False).alias("leaf"))
        child = lambda i, j: F.struct((F.col("level") + 1).alias("level"), (F.col("nx") * 2 + i).alias("nx"), (F.col("ny") * 2 + j).alias("ny"))
        here = F.array(F.struct(*(F.col(c).alias(c) for c in NODE)))
        square = lambda v: v * v
        off = lambda p, c: square(F.greatest(F.col(f"{c}0") - p, p - F.col(f"{c}1"), F.lit(0.0)))
        far = lambda p, c: square(F.greatest(F.abs(p - F.col(f"{c}0")), F.abs(p - F.col(f"{c}1"))))
        for _ in range(self.depth):
            rows = rows.select(*own, F.explode(F.when(F.col("leaf"), here).otherwise(F.array(*(child(i, j) for i in (0, 1) for j in (0, 1))))).alias("node")).select(*own, "node.*")
            met = rows.join(self.nodes, NODE).withColumns({"_near": off(px, "x") + off(py, "y"), "_far": far(px, "x") + far(py, "y")})
            met = met.withColumn("_least", F.min("_far").over(Window.partitionBy(*key)))
            rows = met.where(F.col("_near") <= F.col("_least")).select(*own, *NODE, "leaf")
        cost = lambda s: F.struct((square(s["sx"] - px) + square(s["sy"] - py)).alias("d"), s["site_id"].alias("site_id"), s["sx"].alias("sx"), s["sy"].alias("sy"))
        found = rows.join(self.leaves, NODE).select(*own, F.transform("sites", cost).alias("_sites"))
        found = found.select(*own, F.array_min("_sites").alias("_best"), *([F.filter("_sites", lambda s: s["d"] < F.col(within)).alias("_closer")] if within else []))
        rest = [F.first(c).alias(c) for c in own if c not in key]
        more = [F.flatten(F.collect_list("_closer")).alias("closer")] if within else []
        return found.groupBy(*key).agg(*rest, F.min("_best").alias("best"), *more).select(*own, "best", *(["closer"] if within else []))


