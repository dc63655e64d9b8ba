"""More of the library's queries with their DuckDB twins: graphs, exact Voronoi diagrams, break points, JSON documents."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tessella import catalog as c
from tessella.catalog import BESIDE, CLOUDS, EDGES, LABELLED, SEGMENTS, TRIANGLES, UNIFORM, W, labelled, query, wh
from tessella.functions import draws, geometry as g
from tessella.operators import boxes, centroid, components, graphs, growth, halfedges, lines, merging, raster, sampling, voronoi
from tessella.plans.stage import shared_dir, staged
from tessella.sources import fixtures as fx, json_files as js

KEY = "((least(x1, x2) * 2147483648 + least(y1, y2)) * 2 + CASE WHEN y1 = y2 THEN 1 ELSE 0 END)"
#: Half-edges of the boundary edges between packed corners, and those that end a line.
HALF = f"ke AS (SELECT *, {KEY} AS e, (x1 % {W}) * 2147483648 + y1 % {W} AS c1, (x2 % {W}) * 2147483648 + y2 % {W} AS c2 FROM edges), half AS (SELECT e, e * 2 AS id, c1 AS u, c2 AS v FROM ke UNION ALL SELECT e, e * 2 + 1, c2, c1 FROM ke), deg AS (SELECT u AS c, count(*) AS n FROM half GROUP BY u)"
#: The components of the edges that meet in corners of degree 2: (e, line).
CHAINS = "ties AS (SELECT a.e AS a, b.e AS b FROM half a JOIN half b ON a.u = b.u AND a.e <> b.e JOIN deg ON deg.c = a.u AND deg.n = 2), met AS (SELECT e, e AS root FROM ke UNION SELECT ties.b, met.root FROM met JOIN ties ON ties.a = met.e WHERE met.root < ties.b), chain AS (SELECT e, min(root) AS line FROM met GROUP BY e)"


@query(f"""WITH RECURSIVE {LABELLED}, {BESIDE}, {EDGES}, ke AS (SELECT *, {KEY} AS e, least(group_a, group_b) AS lo, greatest(group_a, group_b) AS hi FROM edges),
ends AS (SELECT e, lo, hi, x1 AS x, y1 AS y FROM ke UNION ALL SELECT e, lo, hi, x2, y2 FROM ke), ties AS (SELECT DISTINCT a.e AS a, b.e AS b FROM ends a JOIN ends b USING (x, y, lo, hi) WHERE a.e <> b.e),
met AS (SELECT e, e AS root FROM ke UNION SELECT ties.b, met.root FROM met JOIN ties ON ties.a = met.e WHERE met.root < ties.b), lines AS (SELECT e, min(root) AS line FROM met GROUP BY e)
SELECT CAST(dense_rank() OVER (ORDER BY line) AS BIGINT) AS label, x1, y1, x2, y2, group_a, group_b FROM ke JOIN lines USING (e)""")
def i2_label_edges(spark, sf_dir):
    return components.label_edges(raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir)))


@query(f"WITH RECURSIVE {LABELLED}, {BESIDE}, {EDGES}, {HALF}, {CHAINS} SELECT line, CAST(count(DISTINCT e) AS BIGINT) AS n_edges, bool_and(n = 2) AS closed FROM chain JOIN half USING (e) JOIN deg ON deg.c = half.u GROUP BY line")
def i7_polylines(spark, sf_dir):
    return components.polylines(raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir)), *wh(spark, sf_dir))


#: Every line walked from either of its stops; the way that ends with the lesser half-edge counts.
WALKS = f"""{HALF}, {CHAINS}, loops AS (SELECT line, min(u) AS c FROM chain JOIN half USING (e) JOIN deg ON deg.c = half.u GROUP BY line HAVING bool_and(n = 2)), stops AS (SELECT c FROM deg WHERE n <> 2 UNION SELECT c FROM loops),
walk AS (SELECT id AS head, id, e, v, CAST(1 AS BIGINT) AS seq, u AS c0 FROM half WHERE u IN (FROM stops) UNION ALL SELECT w.head, h.id, h.e, h.v, w.seq + 1, w.c0 FROM walk w JOIN half h ON h.u = w.v AND h.e <> w.e WHERE w.v NOT IN (FROM stops)),
last AS (SELECT head, arg_max(id, seq) AS to_id FROM walk GROUP BY head), best AS (SELECT line, arg_min(head, to_id) AS head FROM last JOIN half ON half.id = last.head JOIN chain USING (e) GROUP BY line),
way AS (SELECT line, seq, v AS c FROM best JOIN walk USING (head) UNION ALL SELECT line, CAST(0 AS BIGINT), c0 FROM best JOIN walk USING (head) WHERE seq = 1)"""
_WAY = "line, seq, c // 2147483648 AS x, c % 2147483648 AS y FROM way"


@query(f"WITH RECURSIVE {LABELLED}, {BESIDE}, {EDGES}, {WALKS} SELECT {_WAY}")
def i8_ordered_lines(spark, sf_dir):
    return lines.ordered_lines(raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir)), *wh(spark, sf_dir))


#: Sides of cells that steps of lines pass, the highest line on each.
_SIDES = f"st AS (SELECT line, c // 2147483648 AS x, c % 2147483648 AS y, lead(c // 2147483648) OVER w AS nx, lead(c % 2147483648) OVER w AS ny FROM way WINDOW w AS (PARTITION BY line ORDER BY seq)), sd AS (SELECT CASE WHEN x <> nx AND (x + 1) % {W} <> nx THEN nx ELSE x END AS x, CASE WHEN y <> ny AND (y + 1) % {W} <> ny THEN ny ELSE y END AS y, CASE WHEN x <> nx THEN 'low_y' ELSE 'low_x' END AS side, line FROM st WHERE nx IS NOT NULL)"


@query(f"WITH RECURSIVE {LABELLED}, {BESIDE}, {EDGES}, {WALKS}, {_SIDES} SELECT x, y, side, max(line) AS line FROM sd GROUP BY ALL")
def i15_voronoi_partition(spark, sf_dir):
    """Sites to regions, their borders, the borders' lines in order, and these on the sides of cells."""
    w, h = wh(spark, sf_dir)
    return lines.border_map(lines.ordered_lines(raster.boundary_edges(labelled(spark, sf_dir), w, h), w, h), w, h)


#: The corner graph: borders as cells meet them, corners numbered by their first touch.
GRAPH = f"""bo AS (SELECT a.x, a.y, (a.x * {W} + a.y) * 4 AS t, a.x AS ax, a.y AS ay, a.x AS bx, (a.y + 1) % {W} AS by_, 0 AS slot FROM lab a JOIN lab b ON b.x = (a.x + {W - 1}) % {W} AND b.y = a.y WHERE a.label <> b.label
UNION ALL SELECT a.x, a.y, (a.x * {W} + a.y) * 4 + 2, a.x, a.y, (a.x + 1) % {W}, a.y, 3 FROM lab a JOIN lab b ON b.x = a.x AND b.y = (a.y + {W - 1}) % {W} WHERE a.label <> b.label),
tc AS (SELECT x, y, min(t) AS t FROM (SELECT ax AS x, ay AS y, t FROM bo UNION ALL SELECT bx, by_, t + 1 FROM bo) GROUP BY x, y), vx AS (SELECT x, y, CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS visit FROM tc),
ed AS (SELECT p.visit AS src, q.visit AS dst, slot FROM bo JOIN vx p ON p.x = ax AND p.y = ay JOIN vx q ON q.x = bx AND q.y = by_), eb AS (SELECT src, dst, slot FROM ed UNION ALL SELECT dst, src, xor(slot, 1) FROM ed)"""


def _graph(spark, sf_dir):
    v, e = graphs.corner_graph(labelled(spark, sf_dir), *wh(spark, sf_dir))
    return staged(v), staged(e)


@query(f"WITH {LABELLED}, {GRAPH} SELECT visit, x, y FROM vx")
def d11_vertices(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(f"WITH {LABELLED}, {GRAPH} SELECT src, dst, slot FROM eb")
def i6_corner_graph(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"WITH {LABELLED}, {GRAPH} SELECT CAST(row_number() OVER (ORDER BY src, slot) - 1 AS BIGINT) AS ord, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM eb JOIN vx p ON p.visit = src JOIN vx q ON q.visit = dst WHERE src < dst")
def g1_traversal_history(spark, sf_dir):
    return graphs.traversal(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {LABELLED}, {GRAPH}, r AS (SELECT CAST(0 AS BIGINT) AS v UNION SELECT dst FROM r JOIN eb ON src = v) SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM eb JOIN vx p ON p.visit = src JOIN vx q ON q.visit = dst WHERE src < dst AND src IN (SELECT v FROM r)")
def i31_line_segments(spark, sf_dir):
    return graphs.segments(*_graph(spark, sf_dir))


@query(f"WITH {LABELLED}, {BESIDE}, p AS (SELECT DISTINCT least(label, other) AS a, greatest(label, other) AS b FROM (FROM nx UNION ALL FROM ny)) SELECT label, CAST(count(*) AS BIGINT) AS edges FROM (SELECT a AS label FROM p UNION ALL SELECT b FROM p) GROUP BY label")
def e15_edge_counts(spark, sf_dir):
    return graphs.edge_counts(raster.adjacency(labelled(spark, sf_dir), *wh(spark, sf_dir)))


@query(f"WITH {LABELLED}, {BESIDE}, {EDGES} SELECT least(group_a, group_b) AS lo, greatest(group_a, group_b) AS hi, list_sort(list({KEY})) AS segments, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY ALL")
def e12_segments_by_label(spark, sf_dir):
    e = raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir))
    return e.groupBy(F.least("group_a", "group_b").alias("lo"), F.greatest("group_a", "group_b").alias("hi")).agg(F.sort_array(F.collect_list(components.edge_key())).alias("segments"), F.count("*").alias("n"))


@query(f"WITH {TRIANGLES} SELECT id FROM tri WHERE (ax > 300 AND ax < 500 AND ay > 300 AND ay < 500) OR (bx > 300 AND bx < 500 AND by_ > 300 AND by_ < 500) OR (cx > 300 AND cx < 500 AND cy > 300 AND cy < 500)")
def c6_interior_rings(spark, sf_dir):
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"), ("cx", "cy"))])
    return graphs.touching_interior(fx.triangles(spark, sf_dir).select("id", ring.alias("ring")), 300, 500).select("id")


#: Random borders' order; those that no way of earlier ones goes around are the forest, its last ones stay borders.
_MERGED = f"""p AS (SELECT DISTINCT least(label, other) AS a, greatest(label, other) AS b FROM (FROM nx UNION ALL FROM ny)), o AS (SELECT a, b, row_number() OVER (ORDER BY {draws.bits_sql('a * 1000003 + b', '1')}, a, b) AS k FROM p),
both_ AS (SELECT a, b, k FROM o UNION ALL SELECT b, a, k FROM o), r AS (SELECT k, a AS v FROM o UNION SELECT r.k, e.b FROM r JOIN both_ e ON e.a = r.v AND e.k < r.k), f AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.v = o.b)),
t AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM f), n AS (SELECT DISTINCT label FROM lab), kept AS (SELECT a, b FROM t WHERE n <= (SELECT greatest(0, count(*) - 7) FROM n)), kb AS (FROM kept UNION ALL SELECT b, a FROM kept),
mg AS (SELECT label, label AS root FROM n UNION SELECT kb.b, mg.root FROM mg JOIN kb ON kb.a = mg.label), z AS (SELECT label, CAST(dense_rank() OVER (ORDER BY min(root)) AS BIGINT) AS region FROM mg GROUP BY label)"""


@query(f"WITH RECURSIVE {LABELLED}, {BESIDE}, {_MERGED} SELECT x, y, region FROM lab JOIN z USING (label)")
def i17_aggregated_cells(spark, sf_dir):
    grid, _, found = c._merged(spark, sf_dir)
    return grid.join(found, "label").select("x", "y", "region")


#: The region that each border's two ends belong to before it: (k, v), from a as r and from b as rb.
_BEFORE = "rb AS (SELECT k, b AS v FROM o UNION SELECT rb.k, e.b FROM rb JOIN both_ e ON e.a = rb.v AND e.k < rb.k), la AS (SELECT k, min(v) AS v FROM r GROUP BY k), lb AS (SELECT k, min(v) AS v FROM rb GROUP BY k)"


def _tree(spark, sf_dir):
    grid = labelled(spark, sf_dir)
    pairs = staged(raster.adjacency(grid, *wh(spark, sf_dir)))
    return grid, pairs, staged(merging.merge_tree(pairs))


@query(f"WITH RECURSIVE {LABELLED}, {BESIDE}, {_MERGED}, {_BEFORE} SELECT t.n AS step, least(la.v, lb.v) AS kept, greatest(la.v, lb.v) AS gone FROM t JOIN la ON la.k = t.k JOIN lb ON lb.k = t.k")
def i17_merge_tree(spark, sf_dir):
    """Every merge of the suppliers' regions in order, down to the last."""
    return _tree(spark, sf_dir)[2]


#: Numbers of merges whose borders are looked up in one tree.
MERGES = (1, 3, 7, 40)


@query(f"""WITH RECURSIVE {LABELLED}, {BESIDE}, {_MERGED}, mm AS (SELECT unnest({list(MERGES)})::BIGINT AS merges), tb AS (SELECT a, b, n FROM t UNION ALL SELECT b, a, n FROM t),
af AS (SELECT merges, label, label AS root FROM n, mm UNION SELECT af.merges, tb.b, af.root FROM af JOIN tb ON tb.a = af.label AND tb.n <= af.merges), rg AS (SELECT merges, label, min(root) AS region FROM af GROUP BY merges, label)
SELECT DISTINCT i.merges, least(i.region, j.region) AS a, greatest(i.region, j.region) AS b FROM p JOIN rg i ON i.label = p.a JOIN rg j ON j.label = p.b AND j.merges = i.merges WHERE i.region <> j.region""")
def i18_inherited_adjacency(spark, sf_dir):
    """What borders on what after several numbers of merges, from one tree."""
    grid, pairs, tree = _tree(spark, sf_dir)
    return merging.adjacency_after(pairs, merging.regions_after(grid.select("label"), tree, list(MERGES)))


_S = 4096.0
#: Voronoi diagrams by brute force: of every cell, each bisector and side of the square, cut by all its other half-planes.
VORONOI = f"""vs AS (SELECT s_suppkey AS id, {UNIFORM('s_suppkey')} * 4096 AS x, {UNIFORM('s_suppkey', '1')} * 4096 AS y FROM supplier),
pl AS (SELECT a.id AS s, a.x AS sx, a.y AS sy, b.id AS e, b.x - a.x AS a, b.y - a.y AS b, (b.x * b.x + b.y * b.y - a.x * a.x - a.y * a.y) / 2 AS c, (a.x + b.x) / 2 AS px, (a.y + b.y) / 2 AS py FROM vs a JOIN vs b ON a.id <> b.id
UNION ALL SELECT id, x, y, e, a, b, c, px, py FROM vs, (VALUES (-1, 0.0, -1.0, 0.0, 0.0, 0.0), (-2, 1.0, 0.0, {_S}, {_S}, 0.0), (-3, 0.0, 1.0, {_S}, {_S}, {_S}), (-4, -1.0, 0.0, 0.0, 0.0, {_S})) v(e, a, b, c, px, py)),
cu AS (SELECT l.s, l.sx, l.sy, l.e, l.px, l.py, -l.b AS dx, l.a AS dy, q.c - q.a * l.px - q.b * l.py AS num, q.b * l.a - q.a * l.b AS den FROM pl l JOIN pl q ON q.s = l.s AND q.e <> l.e),
sg AS (SELECT s, sx, sy, e, px, py, dx, dy, max(num / den) FILTER (den < 0) AS lo, min(num / den) FILTER (den > 0) AS hi FROM cu GROUP BY ALL HAVING bool_and(den <> 0 OR num >= 0)),
ve AS (SELECT s, sx, sy, e, px + lo * dx AS x1, py + lo * dy AS y1, px + hi * dx AS x2, py + hi * dy AS y2 FROM sg WHERE lo < hi AND (hi - lo) * sqrt(dx * dx + dy * dy) > 1e-9),
tr AS (SELECT *, abs((x1 - sx) * (y2 - sy) - (y1 - sy) * (x2 - sx)) / 2 AS k FROM ve), ce AS (SELECT s AS site_id, CAST(count(*) AS BIGINT) AS n_edges, sum(k) AS area, sum(k * (sx + x1 + x2)) / 3 / sum(k) AS cx, sum(k * (sy + y1 + y2)) / 3 / sum(k) AS cy FROM tr GROUP BY s)"""


def _rings(spark, sf_dir):
    return staged(c._cells(spark, sf_dir))


def _sites(spark, sf_dir):
    return c.plane_sites(spark, sf_dir)


@query(f"WITH {VORONOI} SELECT site_id, n_edges, round(area, 3) AS area, round(cx, 4) AS cx, round(cy, 4) AS cy FROM ce")
def i21_voronoi_cells(spark, sf_dir):
    rings = _rings(spark, sf_dir)
    found = voronoi.centroids(rings).join(rings.select("site_id", F.size("ring").cast("long").alias("n_edges")), "site_id")
    return found.select("site_id", "n_edges", F.round("area", 3).alias("area"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@query(f"WITH {VORONOI} SELECT s AS a, e AS b FROM ve WHERE s < e")
def i30_region_graph(spark, sf_dir):
    return voronoi.region_graph(_rings(spark, sf_dir))


_P, _Q = "{'x': round(x1, 3) + 0.0, 'y': round(y1, 3) + 0.0}", "{'x': round(x2, 3) + 0.0, 'y': round(y2, 3) + 0.0}"


@query(f"WITH {VORONOI}, pq AS (SELECT DISTINCT least({_P}, {_Q}) AS p, greatest({_P}, {_Q}) AS q FROM ve) SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM pq WHERE p <> q")
def i29_vertex_graph(spark, sf_dir):
    return voronoi.vertex_graph(_rings(spark, sf_dir), 3)


@query(f"WITH {VORONOI} SELECT s AS a, e AS b, round(p.cx, 4) AS x1, round(p.cy, 4) AS y1, round(q.cx, 4) AS x2, round(q.cy, 4) AS y2 FROM ve JOIN ce p ON p.site_id = s JOIN ce q ON q.site_id = e WHERE s < e")
def i32_adjacency_segments(spark, sf_dir):
    rings = _rings(spark, sf_dir)
    at = voronoi.centroids(rings)
    one, two = (at.select(F.col("site_id").alias(k), F.round("cx", 4).alias(f"x{n}"), F.round("cy", 4).alias(f"y{n}")) for n, k in ((1, "a"), (2, "b")))
    return voronoi.region_graph(rings).join(one, "a").join(two, "b").select("a", "b", "x1", "y1", "x2", "y2")


@query(f"WITH {VORONOI}, iv AS (SELECT x1 AS x, y1 AS y FROM ve UNION ALL SELECT x2, y2 FROM ve), ex AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM iv WHERE x > 1e-6 AND x < {_S} - 1e-6 AND y > 1e-6 AND y < {_S} - 1e-6) SELECT round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1, round((x1 - x0) * (y1 - y0), 2) AS area FROM ex")
def i27_bound_at_extent(spark, sf_dir):
    """The cells, cut at the extent of the diagram's vertices, fill just that."""
    rings = staged(voronoi.bounded(_sites(spark, sf_dir), _S))
    p = rings.select(F.explode("ring").alias("p")).agg(*(F.round(f(f"p.{v}"), 4).alias(f"{v}{k}") for k, f in ((0, F.min), (1, F.max)) for v in "xy"))
    return p.crossJoin(voronoi.centroids(rings).agg(F.round(F.sum("area"), 2).alias("area")))


_DISK = 0.05


@query(f"WITH RECURSIVE {c._POINTS}, p AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM (SELECT min(id) AS id, px, py FROM pts GROUP BY px, py)), g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS kept UNION ALL SELECT p.k, CASE WHEN len(list_filter(g.kept, lambda q: (p.px - q.x) * (p.px - q.x) + (p.py - q.y) * (p.py - q.y) < {_DISK * _DISK!r})) = 0 THEN list_append(g.kept, {{'id': p.id, 'x': p.px, 'y': p.py}}) ELSE g.kept END FROM g JOIN p ON p.k = g.k + 1) SELECT u.id AS id FROM (SELECT unnest(kept) AS u FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1))")
def j8_poisson_disk(spark, sf_dir):
    return sampling.poisson_disk(c._points(spark, sf_dir), _DISK).select("id")


_KEPT = c.ORACLES["j8_poisson_disk"]


@query(f"SELECT id, CAST(0 AS BIGINT) AS too_near FROM ({_KEPT})")
def j8_fill(spark, sf_dir):
    """The points of the table that dart throwing keeps, after the square around them is filled, and what came too near to them."""
    start = c._points(spark, sf_dir)
    kept = staged(sampling.fill(start, _DISK))
    near = sampling.close_pairs(kept, kept, _DISK).groupBy("id").agg(F.count("*").alias("n"))
    return kept.join(start.select("id"), "id", "left_semi").join(near, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("too_near"))


@query("SELECT event_id, true AS reached FROM events")
def j8_fill_reaches(spark, sf_dir):
    """From a twentieth of a start, in one corner: no event's place is left farther than twice the radius from a point."""
    start = c._points(spark, sf_dir).where("px < 0.2 and py < 0.2")
    kept = staged(sampling.fill(start, _DISK * 2))
    probes = staged(fx.clouds(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("x") / 512).alias("px"), (F.col("y") / 512).alias("py")))
    named = kept.select((-F.col("id") - 1).alias("id"), "px", "py")
    near = sampling.close_pairs(probes, named, _DISK * 4).select("id").distinct().withColumn("hit", F.lit(True))
    return probes.join(near, "id", "left").select(F.col("id").alias("event_id"), F.coalesce("hit", F.lit(False)).alias("reached"))


@query("SELECT CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS too_near, CAST(1 AS BIGINT) AS enough FROM part LIMIT 1")
def j8_fill_grid_invariant(spark, sf_dir):
    """Cells of the grid grown from the parts' points, none nearer than the radius less what cutting to whole numbers takes, and not far fewer than fit."""
    size, radius = 256, 24.0
    at = staged(sampling.fill_grid(c._points(spark, sf_dir), size, radius))
    near = sampling.close_pairs(at.select("id", F.col("x").alias("px"), F.col("y").alias("py")), at.select("id", F.col("x").alias("px"), F.col("y").alias("py")), radius - math.sqrt(2))
    least = int(0.6 * size * size / (radius * radius))
    return at.agg(F.count_if(~(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1))).alias("outside"), (F.count("*") >= least).cast("long").alias("enough")).crossJoin(near.agg(F.count("*").alias("too_near")))


_K = "o_orderkey"
_N = lambda a, b: f"sqrt(-2 * ln({UNIFORM(_K, a)})) * cos(2 * pi() * {UNIFORM(_K, b)})"
_CHI = lambda n, at=0: f"(SELECT sum(pow({_N(f'2 * k.range + {at}', f'2 * k.range + {at + 1}')}, 2)) FROM range({n}) k)"


def _cdf(mean: float) -> list[float]:
    out, total, p = [], 0.0, math.exp(-mean)
    for k in range(math.ceil(mean + 10 * math.sqrt(mean) + 40)):
        total += p
        out.append(total)
        p = p * mean / (k + 1)
    return out


_D = 2.5 - 1 / 3
_C = 1 / math.sqrt(9 * _D)
_V = f"pow(1 + {_C!r} * x, 3)"
_GAMMA = f"(SELECT arg_min({_D!r} * v, k) FROM (SELECT k, x, {_V} AS v, u FROM (SELECT k.range AS k, {_N('3 * k.range', '3 * k.range + 1')} AS x, {UNIFORM(_K, '3 * k.range + 2')} AS u FROM range(64) k)) WHERE v > 0 AND ln(u) < 0.5 * x * x + {_D!r} - {_D!r} * v + {_D!r} * ln(greatest(v, 1e-300)))"
_U, _U2 = UNIFORM(_K), UNIFORM(_K, "1")


@query(f"""SELECT {_K} AS id, CAST(len(list_filter({_cdf(4.0)}, lambda x: {_U} >= x)) AS BIGINT) AS poisson, CAST((SELECT count(*) FROM range(8) k WHERE {UNIFORM(_K, 'k.range')} < 0.4) AS BIGINT) AS binomial,
CAST((SELECT sum(floor(ln(1 - {UNIFORM(_K, 'k.range')}) / {math.log(0.5)!r})) FROM range(3) k) AS BIGINT) AS negative_binomial, round(exp(0.5 * ({_N('0', '1')})), 6) AS lognormal,
round({_GAMMA} * 2.0, 6) AS gamma, round({_CHI(4)}, 6) AS chi_squared, round(({_N('0', '1')}) / sqrt({_CHI(5, 2)} / 5), 6) AS student_t,
round(({_CHI(3)} / 3) / ({_CHI(6, 6)} / 6), 5) AS fisher_f, CASE WHEN {_U} < 0.1 THEN 0 WHEN {_U} < 0.3 THEN 1 WHEN {_U} < 0.6 THEN 2 ELSE 3 END AS discrete,
round(CASE WHEN {_U} < 0.25 THEN {_U2} WHEN {_U} < 0.5 THEN 1 + 2 * {_U2} ELSE 3 + 3 * {_U2} END, 6) AS piecewise FROM orders""")
def m_compound_distributions(spark, sf_dir):
    k, u, v = F.col(_K), draws.uniform(F.col(_K)), draws.uniform(F.col(_K), 1)
    r = lambda x, n=6: F.round(x, n)
    made = {"poisson": draws.Distribution(draws.poisson, 4.0)(k), "binomial": draws.Distribution(draws.binomial, 8, 0.4)(k).cast("long"), "negative_binomial": draws.negative_binomial(k, 3, 0.5), "lognormal": r(draws.Distribution(draws.lognormal, 0.0, 0.5)(k)), "gamma": r(draws.gamma(k, 2.5, 2.0)), "chi_squared": r(draws.chi_squared(k, 4)), "student_t": r(draws.student_t(k, 5)), "fisher_f": r(draws.fisher_f(k, 3, 6), 5), "discrete": draws.discrete(u, [1, 2, 3, 4]), "piecewise": r(draws.piecewise_constant(u, v, [0.0, 1.0, 3.0, 6.0], [1, 1, 2]))}
    return fx.table(spark, sf_dir, "orders").select(k.alias("id"), *(x.alias(n) for n, x in made.items()))


#: The quadratic of two parabolas over a directrix at -80.
_QUAD = f"{SEGMENTS}, qa AS (SELECT *, bx - ax AS a, 2.0 * (by_ * (ax + 80.0) - ay * (bx + 80.0)) AS b, ay * ay * (bx + 80.0) - by_ * by_ * (ax + 80.0) - (bx - ax) * (ax + 80.0) * (bx + 80.0) AS c FROM seg WHERE abs(bx - ax) > 1), qr AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS r1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a) AS r2 FROM qa WHERE b * b - 4 * a * c > 1e-6), qy AS (SELECT *, CASE WHEN ax > bx THEN least(r1, r2) ELSE greatest(r1, r2) END AS y, CASE WHEN r1 > least(ay, by_) AND r1 < greatest(ay, by_) THEN r1 ELSE r2 END AS t FROM qr)"


@query(f"WITH {_QUAD} SELECT id, round(((y - ay) * (y - ay) + ax * ax - 6400.0) / (2 * (ax + 80.0)), 3) AS px, round(y, 4) AS py, round(t, 4) AS inner_y FROM qy")
def b17_break_points(spark, sf_dir):
    """The break point of two arcs in the order of their foci, and the height between the foci."""
    d, (ax, ay, bx, by) = F.lit(-80.0), map(F.col, ("ax", "ay", "bx", "by"))
    x, y = g.break_point(d, ax, ay, bx, by)
    a, b, k = g._break(d, ax, ay, bx, by)
    s = fx.segments(spark, sf_dir).where((F.abs(bx - ax) > 1) & (b * b - 4 * a * k > 1e-6))
    return s.select("id", F.round(x, 3).alias("px"), F.round(y, 4).alias("py"), F.round(g.break_between(d, ax, ay, bx, by), 4).alias("inner_y"))


@query(f"WITH {SEGMENTS} SELECT id, round(((ay - by_) * (ay - by_) + bx * bx - ax * ax) / (2 * (bx - ax)), 3) AS on_first, round((ay + by_) / 2, 6) AS level FROM seg WHERE abs(bx - ax) > 1")
def b18_break_on_directrix(spark, sf_dir):
    """A first focus on the directrix, whose arc is a ray, and two foci at one distance from it."""
    ax, ay, bx, by = map(F.col, ("ax", "ay", "bx", "by"))
    x, _ = g.break_point(ax, ax, ay, bx, by)
    return fx.segments(spark, sf_dir).where(F.abs(bx - ax) > 1).select("id", F.round(x, 3).alias("on_first"), F.round(g.break_y(F.lit(-80.0), ax, ay, ax, by), 6).alias("level"))


@query(f"WITH {SEGMENTS}, xs AS (SELECT range * 10.0 - 70 AS x FROM range(8)), q AS (SELECT id, x, ay, ay * ay - (ax * ax + ay * ay - 6400.0 + 2.0 * x * (-80.0 - ax)) AS h FROM seg, xs), pt AS (SELECT id, x, ay - sqrt(h) AS y, 0 AS branch, x AS o FROM q WHERE h > 0 UNION ALL SELECT id, x, ay + sqrt(h), 2, -x FROM q WHERE h > 0) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY branch, o) - 1 AS BIGINT) AS k, x, round(y, 5) AS y FROM pt")
def b20_parabola_line(spark, sf_dir):
    xs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k * 10.0 - 70.0)
    s = fx.segments(spark, sf_dir).select("id", F.posexplode(g.parabola_line(F.lit(-80.0), F.col("ax"), F.col("ay"), xs)).alias("k", "p"))
    return s.select("id", F.col("k").cast("long").alias("k"), "p.x", F.round("p.y", 5).alias("y"))


@query(f"WITH {SEGMENTS} SELECT id, ax < -5 OR ax > 5 OR ay < -5 OR ay > 5 AS outside, ax >= -5 AND ax <= 5 AND ay >= -5 AND ay <= 5 AS inside, ax > -5 AND ax < 5 AND ay > -5 AND ay < 5 AS interior, CAST(xor(id % 4, 1) AS BIGINT) AS other_slot, CAST(id % 1000 * 2147483648 + id % 77 AS BIGINT) AS hash FROM seg")
def b23_box_predicates(spark, sf_dir):
    """Against a square, the slot of an edge at its other end, and the number of a point."""
    x, y, k = F.col("ax"), F.col("ay"), F.col("id")
    return fx.segments(spark, sf_dir).select("id", g.outside_box(x, y, -5, 5).alias("outside"), g.inside_box(x, y, -5, 5).alias("inside"), g.interior_of_box(x, y, -5, 5).alias("interior"), g.complementary(k % 4).alias("other_slot"), g.point_hash(k % 1000, k % 77).alias("hash"))


@query("SELECT n_regionkey, list(n_nationkey * 37 % 11 ORDER BY n_nationkey * 37 % 11, n_nationkey) AS foci FROM nation GROUP BY n_regionkey")
def g8_sorted_foci(spark, sf_dir):
    return fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("n_nationkey") * 37 % 11).alias("x"), "n_nationkey"))), lambda p: p["x"]).alias("foci"))


@query(f"WITH c4 AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 4001 AS x, s_suppkey * 104729 % 3989 AS y FROM supplier), pr AS (SELECT a.id, a.x, a.y, b.id AS other FROM c4 a JOIN c4 b ON a.id > b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 160000) SELECT id, min(other) AS first_near, CAST(count(*) AS BIGINT) AS near FROM pr GROUP BY id")
def g7_first_near(spark, sf_dir):
    """The first of the earlier points that a candidate is too near to, and how many there are."""
    k = F.col("s_suppkey")
    p = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7919 % 4001).alias("px"), (k * 104729 % 3989).alias("py"))
    return sampling.close_pairs(p, p, 400).where("other < id").groupBy("id").agg(F.min("other").alias("first_near"), F.count("*").alias("near"))


#: A ring of twelve corners with vertices and whole edges at the heights of the points that are tried.
_RING = ((2, 2), (6, 2), (6, 5), (9, 5), (9, 2), (14, 2), (14, 9), (11, 9), (9, 12), (6, 9), (4, 9), (2, 6))
_HITS = " + ".join(f"CASE WHEN ({b} > y) <> ({d} > y) AND x < ({p} - {a}) * ((y - {b}) / {float(d - b)}) + {a} THEN 1 ELSE 0 END" for (a, b), (p, d) in zip(_RING, _RING[1:] + _RING[:1]) if b != d)


@query(f"SELECT event_id, ({_HITS}) % 2 = 1 AS inside FROM (SELECT event_id, event_id % 16 AS x, event_id // 16 % 14 AS y FROM events)")
def b12_points_on_the_lattice_of_a_ring(spark, sf_dir):
    """Events on a lattice whose rows are level with vertices and edges of the ring, by the fold over an array of vertices."""
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in _RING])
    k = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select("event_id", g.in_ring(ring, (k % 16).cast("double"), (F.floor(k / 16) % 14).cast("double")).alias("inside"))


_STEP = lambda k: f"((({k}) % 2147483648) * 1103515245 + 12345) % 2147483648"
_CHAIN = f"""kx AS (SELECT user_id, a.range AS at, CAST(sum(pow(least(abs(x - a.range), 512 - abs(x - a.range)), 2)) AS BIGINT) AS k FROM clouds, range(512) a GROUP BY ALL), ky AS (SELECT user_id, a.range AS at, CAST(sum(pow(least(abs(y - a.range), 512 - abs(y - a.range)), 2)) AS BIGINT) AS k FROM clouds, range(512) a GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM clouds), st AS (SELECT user_id, CAST(floor(avg(x)) AS BIGINT) AS x, CAST(floor(avg(y)) AS BIGINT) AS y FROM rk WHERE r <= 2 GROUP BY user_id),
ch AS (SELECT st.user_id, 0 AS n, st.x, st.y, kx.k + ky.k AS cost, (st.user_id * 7919 + 1) % 2147483648 AS s, CAST(1 AS BIGINT) AS seen FROM st JOIN kx ON kx.user_id = st.user_id AND kx.at = st.x JOIN ky ON ky.user_id = st.user_id AND ky.at = st.y
UNION ALL SELECT user_id, n + 1, CASE WHEN go THEN tx ELSE x END, CASE WHEN go THEN ty ELSE y END, CASE WHEN go THEN tc ELSE cost END, s2, seen + CASE WHEN go THEN 1 ELSE 0 END FROM (SELECT *, (tx <> x OR ty <> y) AND (tc < cost OR (s2 + 0.5) / 2147483648.0 < exp(least(0, 2.0 * (cost - tc)))) AS go FROM (SELECT m.*, kx.k + ky.k AS tc, {_STEP('s1')} AS s2 FROM
(SELECT *, greatest(0, least(511, x + CASE s1 // 536870912 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END)) AS tx, greatest(0, least(511, y + CASE s1 // 536870912 WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END)) AS ty FROM (SELECT *, {_STEP('s')} AS s1 FROM ch WHERE n < 200)) m JOIN kx ON kx.user_id = m.user_id AND kx.at = m.tx JOIN ky ON ky.user_id = m.user_id AND ky.at = m.ty)))"""


@query(f"WITH RECURSIVE {CLOUDS}, {_CHAIN} SELECT user_id, x AS cx, y AS cy, cost, seen AS visited FROM ch WHERE n = 200")
def j11_chain(spark, sf_dir):
    """The chain itself, step for step: last cell, its cost and the number of cells visited."""
    found = centroid.chain(fx.clouds(spark, sf_dir), "user_id", "event_id", 512, 512)
    return found.select("user_id", "cx", "cy", "cost", F.size("visits").cast("long").alias("visited"))


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {LABELLED} SELECT * FROM lab")
def a2_matrix_round_trip(spark, sf_dir):
    path = _path(spark, "matrix")
    js.write_matrix(labelled(spark, sf_dir), path)
    return js.read_matrix(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS at, round(s_acctbal, 6) AS element FROM supplier")
def a3_vector_round_trip(spark, sf_dir):
    path = _path(spark, "vector")
    js.write_vector(fx.table(spark, sf_dir, "supplier"), path, ["s_suppkey"], js.number_text(F.col("s_acctbal"), True))
    return js.read_vector(spark, path, "double")


@query("WITH v AS (SELECT s_suppkey, printf('[%.6f, %.6f]', s_acctbal, CAST(s_suppkey AS DOUBLE)) AS j, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN r = 1 THEN '{\"vector\": [' ELSE '' END || j || CASE WHEN r = n THEN ']}' ELSE ', ' END AS value FROM v")
def a3_vector_text(spark, sf_dir):
    """The lines of a document of points, which one after the other are the document."""
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", js.point_text(F.col("s_acctbal"), F.col("s_suppkey")).alias("json"))
    return js.document(s, "vector", ["s_suppkey"])


@query(f"WITH {LABELLED}, {BESIDE}, {EDGES} SELECT x1, y1, x2, y2 FROM edges")
def a4_edges_round_trip(spark, sf_dir):
    path = _path(spark, "edges")
    js.write_edges(raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir)), path)
    return js.read_edges(spark, path)


@query(f"WITH {LABELLED}, {BESIDE}, {EDGES} SELECT group_a AS label, x1, y1, x2, y2 FROM edges")
def a5_labelled_edges_round_trip(spark, sf_dir):
    path = _path(spark, "labelled-edges")
    e = raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir))
    js.write_labelled_edges(e.withColumn("label", F.col("group_a")), path)
    return js.read_labelled_edges(spark, path)


@query(f"WITH {LABELLED}, {BESIDE}, {EDGES} SELECT x1, y1, x2, y2, printf('[[%d, %d], [%d, %d]]', x1, y1, x2, y2) AS json FROM edges")
def a4_edge_lines(spark, sf_dir):
    return raster.boundary_edges(labelled(spark, sf_dir), *wh(spark, sf_dir)).select("x1", "y1", "x2", "y2", js.edge_text().alias("json"))


@query(f"WITH {TRIANGLES} SELECT id, printf('[[%.6f, %.6f], [%.6f, %.6f]]', ax::DOUBLE, ay::DOUBLE, bx::DOUBLE, by_::DOUBLE) AS segment, printf('[[%d, %d], [%d, %d]]', ax, ay, bx, by_) AS whole, printf('{{\"centroid\": [%.6f, %.6f], \"vertices\": [[%.6f, %.6f], [%.6f, %.6f], [%.6f, %.6f]]}}', floor(ax / 4)::DOUBLE, floor(ay / 4)::DOUBLE, ax::DOUBLE, ay::DOUBLE, bx::DOUBLE, by_::DOUBLE, cx::DOUBLE, cy::DOUBLE) AS region FROM tri")
def a6_segment_and_region_text(spark, sf_dir):
    ax, ay, bx, by = map(F.col, ("ax", "ay", "bx", "by"))
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"), ("cx", "cy"))])
    return fx.triangles(spark, sf_dir).select("id", js.segment_text(ax, ay, bx, by).alias("segment"), js.segment_text(ax, ay, bx, by, False).alias("whole"), js.region_text(F.floor(ax / 4), F.floor(ay / 4), ring).alias("region"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS at, n_nationkey * 1.5 AS element FROM nation")
def a9_loaded_vector(spark, sf_dir):
    """A vector found by its name in a folder."""
    folder = _path(spark, "folder")
    js.write_vector(fx.table(spark, sf_dir, "nation"), f"{folder}/weights.json", ["n_nationkey"], js.number_text(F.col("n_nationkey") * 1.5, True))
    return js.loader(spark, folder)("weights")


@query("SELECT CAST(count(DISTINCT n_regionkey) * 1024 AS BIGINT) AS cells, CAST(count(DISTINCT (n_regionkey, n_nationkey * 7 % 32, n_nationkey * 13 % 32)) AS BIGINT) AS regions, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS moved FROM nation")
def j1_growth_regions(spark, sf_dir):
    """Every cell of every map is some seed's, seeds keep their cells, and each region hangs together by the stencil from its seed."""
    maps = c._maps(spark, sf_dir)
    grid = staged(growth.grow(maps, 32, 32))
    key = ["map_id", "x", "y"]
    seeds = maps.groupBy(*key).agg(F.min("label").alias("seed"))
    moved = seeds.join(grid, key).agg(F.count_if(F.col("seed") != F.col("label")).alias("moved"))
    at = lambda x, y: (F.col("map_id") * 32 + x) * 32 + y
    near = grid.select("map_id", "label", at(F.col("x"), F.col("y")).alias("a"), F.explode(F.array(*[F.struct(g.wrap(F.col("x") + i, 32).alias("x"), g.wrap(F.col("y") + j, 32).alias("y")) for i, j in sorted(set(raster.REFERENCE))])).alias("n"))
    links = near.select("map_id", "label", "a", "n.x", "n.y").join(grid.withColumnRenamed("label", "other"), key).where("label = other").select("a", at(F.col("x"), F.col("y")).alias("b"))
    part = grid.select("map_id", "label", at(F.col("x"), F.col("y")).alias("id")).join(components.components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    torn = part.groupBy("map_id", "label").agg(F.countDistinct("component").alias("n")).agg(F.count("*").alias("regions"), F.count_if(F.col("n") != 1).alias("torn"))
    return grid.agg(F.count("*").alias("cells")).crossJoin(torn).crossJoin(moved)


def _grown_sql(seeds: str, w: int, rounds: int) -> str:
    """Growth from seeds (map_id, label, x, y, weight) in SQL: all cells look at their neighbours anew in so many rounds, more than any way has steps."""
    steps = ", ".join(map(str, (*sorted(set(raster.REFERENCE)), (0, 0))))
    u = UNIFORM("x * 2147483648 + y", "(map_id * 1000003 + label) * 64 + 1")
    return f"""sd AS (SELECT map_id, x, y, label, weight FROM (SELECT *, row_number() OVER (PARTITION BY map_id, x, y ORDER BY label) AS nth FROM {seeds}) WHERE nth = 1),
gr AS (SELECT 0 AS i, map_id, x, y, CAST(0 AS BIGINT) AS t, label, weight FROM sd UNION ALL SELECT i + 1, map_id, x, y, b.t, b.label, b.weight FROM (SELECT i, map_id, x, y, min(struct_pack(t := CASE WHEN stay THEN t ELSE t + 1 + CAST(floor(-ln(1 - {u}) * 1000000 / weight) AS BIGINT) END, label := label, weight := weight)) AS b
FROM (SELECT i, map_id, (x + dx + {w}) % {w} AS x, (y + dy + {w}) % {w} AS y, t, label, weight, dx = 0 AND dy = 0 AS stay FROM gr, (VALUES {steps}) d(dx, dy) WHERE i < {rounds} AND (dx <> 0 OR dy <> 0 OR t = 0)) GROUP BY i, map_id, x, y))
SELECT map_id, x, y, label FROM gr WHERE i = {rounds}"""


_NATIONS = f"se AS (SELECT CAST(n_regionkey AS BIGINT) AS map_id, CAST(n_nationkey AS BIGINT) AS label, CAST(n_nationkey AS BIGINT) * 7 % 32 AS x, CAST(n_nationkey AS BIGINT) * 13 % 32 AS y, greatest(1.0, floor(ln(1 - {UNIFORM('n_nationkey')}) / CAST({math.log(1 - 0.33)!r} AS DOUBLE))) AS weight FROM nation)"


@query(f"WITH RECURSIVE {_NATIONS}, {_grown_sql('se', 32, 96)}")
def j1_growth(spark, sf_dir):
    """A map for each region of the world, grown from its nations with geometric weights."""
    return c._grown(spark, sf_dir)


_SUPPLIERS = f"se AS (SELECT CAST(0 AS BIGINT) AS map_id, site_id AS label, sx AS x, sy AS y, greatest(1.0, 4.0 * pow(-ln(1 - {UNIFORM('site_id')}), CAST({1 / 1.5!r} AS DOUBLE))) AS weight FROM sites)"


@query(f"WITH RECURSIVE {c.SITES}, {_SUPPLIERS}, {_grown_sql('se', W, 160)}")
def j2_growth_by_distribution(spark, sf_dir):
    """The suppliers' raster grown from their cells, with weights from a Weibull distribution."""
    at = fx.sites(spark, sf_dir).select(F.lit(0).cast("long").alias("map_id"), F.col("site_id").alias("label"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return growth.grow(growth.weighted(at, draws.Distribution(draws.weibull, 1.5, 4.0)), *wh(spark, sf_dir))


#: Distinct edges of the diagram with rounded ends, and half-edges of its cells in the order that cells have them.
_ROUNDED = "re AS (SELECT s, round(x1, 3) + 0.0 AS x, round(y1, 3) + 0.0 AS y, round(x2, 3) + 0.0 AS tx, round(y2, 3) + 0.0 AS ty, x1 * y2 - x2 * y1 AS k, (x1 - sx) * (y2 - sy) - (x2 - sx) * (y1 - sy) AS turn FROM ve), he AS (SELECT s, CASE WHEN turn > 0 THEN x ELSE tx END AS x, CASE WHEN turn > 0 THEN y ELSE ty END AS y, CASE WHEN turn > 0 THEN tx ELSE x END AS tx, CASE WHEN turn > 0 THEN ty ELSE y END AS ty FROM re WHERE x <> tx OR y <> ty)"


def _faces(spark, sf_dir):
    return staged(halfedges.faces(halfedges.half_edges(voronoi.vertex_graph(_rings(spark, sf_dir), 3))))


@query(f"WITH {VORONOI}, {_ROUNDED} SELECT a.x, a.y, a.tx, a.ty, b.tx AS nx, b.ty AS ny FROM he a JOIN he b ON b.s = a.s AND b.x = a.tx AND b.y = a.ty")
def d9_half_edges(spark, sf_dir):
    """Half-edges of the cells with the end of the next one, from the edges alone: order around vertices, not cells."""
    found = _faces(spark, sf_dir)
    inner = halfedges.outlines(found).where("area > 0").select("face")
    after = found.select(F.col("id").alias("next"), F.col("tx").alias("nx"), F.col("ty").alias("ny"))
    return found.join(inner, "face").join(after, "next").select("x", "y", "tx", "ty", "nx", "ny")


@query(f"WITH {VORONOI}, {_ROUNDED} SELECT min({{'x': x, 'y': y}}).x AS x, min({{'x': x, 'y': y}}).y AS y, CAST(count(*) AS BIGINT) AS n_edges, round(sum(x * ty - tx * y) / 2, 2) AS area FROM he GROUP BY s")
def d9_rings(spark, sf_dir):
    """Faces walked by their half-edges, in order: least vertex, edges, and the area by consecutive vertices."""
    found = _faces(spark, sf_dir)
    n = found.groupBy("face").agg(F.count("*").alias("n"))
    after = found.join(n, "face").select("face", F.pmod(F.col("seq") - 1, F.col("n")).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    at = F.min(F.struct("x", "y"))
    rings = found.join(after, ["face", "seq"]).groupBy("face").agg(at.alias("p"), F.count("*").alias("n_edges"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area")).where("area > 0")
    return rings.select("p.x", "p.y", "n_edges", F.round("area", 2).alias("area"))


@query(f"WITH {VORONOI}, {_ROUNDED}, hk AS (SELECT *, x * ty - tx * y AS k FROM he), hc AS (SELECT s, round(sum((x + tx) * k) / (3 * sum(k)), 3) AS cx, round(sum((y + ty) * k) / (3 * sum(k)), 3) AS cy FROM hk GROUP BY s) SELECT a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2 FROM ve JOIN hc a ON a.s = ve.s JOIN hc b ON b.s = e WHERE a.cx < b.cx")
def d9_region_adjacency(spark, sf_dir):
    """Faces that share an edge, by the half-edges' twins, named by their centroids."""
    found = _faces(spark, sf_dir)
    k = F.col("x") * F.col("ty") - F.col("tx") * F.col("y")
    at = found.groupBy("face").agg(F.sum(k).alias("k"), F.sum((F.col("x") + F.col("tx")) * k).alias("sx"), F.sum((F.col("y") + F.col("ty")) * k).alias("sy")).where("k > 0")
    at = staged(at.select("face", F.round(F.col("sx") / (3 * F.col("k")), 3).alias("cx"), F.round(F.col("sy") / (3 * F.col("k")), 3).alias("cy")))
    one, two = (at.select(F.col("face").alias(f), F.col("cx").alias(f"c{f}"), F.col("cy").alias(f"d{f}")) for f in ("a", "b"))
    pairs = halfedges.neighbours(found).join(one, "a").join(two, "b")
    first = F.col("ca") < F.col("cb")
    pick = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    return pairs.select(pick("ca", "cb").alias("x1"), pick("da", "db").alias("y1"), pick("cb", "ca").alias("x2"), pick("db", "da").alias("y2"))


_LO, _HI = 500.0, 3500.0
_CUTS = f"""dd AS (SELECT x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM ve WHERE s < e), tt AS (SELECT *, greatest(0, coalesce(least(({_LO} - x1) / nullif(dx, 0), ({_HI} - x1) / nullif(dx, 0)), 0), coalesce(least(({_LO} - y1) / nullif(dy, 0), ({_HI} - y1) / nullif(dy, 0)), 0)) AS t1,
least(1, coalesce(greatest(({_LO} - x1) / nullif(dx, 0), ({_HI} - x1) / nullif(dx, 0)), 1), coalesce(greatest(({_LO} - y1) / nullif(dy, 0), ({_HI} - y1) / nullif(dy, 0)), 1)) AS t2 FROM dd),
ct AS (SELECT DISTINCT round(x1 + t1 * dx, 3) + 0.0 AS x1, round(y1 + t1 * dy, 3) + 0.0 AS y1, round(x1 + t2 * dx, 3) + 0.0 AS x2, round(y1 + t2 * dy, 3) + 0.0 AS y2 FROM tt WHERE t1 < t2),
bp AS (SELECT x, y FROM (SELECT x1 AS x, y1 AS y FROM ct UNION SELECT x2, y2 FROM ct UNION SELECT * FROM (VALUES ({_LO}, {_LO}), ({_LO}, {_HI}), ({_HI}, {_LO}), ({_HI}, {_HI})) v(x, y)) WHERE x IN ({_LO}, {_HI}) OR y IN ({_LO}, {_HI})),
bo AS (SELECT *, CASE WHEN x = {_LO} THEN {_HI} - y WHEN y = {_LO} THEN {_HI} - {_LO} + x - {_LO} WHEN x = {_HI} THEN 2 * ({_HI} - {_LO}) + y - {_LO} ELSE 3 * ({_HI} - {_LO}) + {_HI} - x END AS place FROM bp),
bb AS (SELECT x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM bo WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_WAYS = lambda t: f"SELECT least({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) AS p, greatest({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) AS q FROM {t}"


def _cropped(spark, sf_dir):
    return staged(halfedges.crop(voronoi.vertex_graph(_rings(spark, sf_dir), 9), _LO, _HI, 3))


@query(f"WITH {VORONOI}, {_CUTS}, al AS (SELECT * FROM ct UNION ALL SELECT x, y, nx, ny FROM bb), wy AS ({_WAYS('al')}) SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM wy WHERE p <> q")
def i26_cropped_graph(spark, sf_dir):
    """The diagram's edges within a smaller square, cut at its border, and that border (the exterior edges) between the cuts."""
    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    return _cropped(spark, sf_dir).select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).select(F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


@query(f"WITH {VORONOI}, {_CUTS}, fa AS (SELECT DISTINCT s FROM (SELECT s, x1 AS a1, y1 AS b1, x2 - x1 AS dx, y2 - y1 AS dy FROM ve)), n AS (SELECT count(*) AS edges FROM (SELECT 1 FROM ct WHERE x1 <> x2 OR y1 <> y2 UNION ALL SELECT 1 FROM bb)), v AS (SELECT count(*) AS corners FROM (SELECT x1, y1 FROM ct UNION SELECT x2, y2 FROM ct UNION SELECT x, y FROM bb)) SELECT CAST(edges - corners + 1 AS BIGINT) AS faces, CAST({(_HI - _LO) ** 2} AS DOUBLE) AS area FROM n, v")
def i28_cropped_faces(spark, sf_dir):
    """Faces of the cropped graph, walked again after the crop: their number (Euler's) and area."""
    found = halfedges.outlines(halfedges.faces(halfedges.half_edges(_cropped(spark, sf_dir)))).where("area > 0")
    return found.agg(F.count("*").alias("faces"), F.round(F.sum("area"), 2).alias("area"))


@query(f"""WITH it AS (SELECT p_brand AS grp, p_partkey AS id, p_size % 7 AS weight FROM part WHERE p_size % 7 > 0), cu AS (SELECT grp, id, CAST(sum(weight) OVER (PARTITION BY grp ORDER BY id) - weight AS DOUBLE) AS before, sum(weight) OVER (PARTITION BY grp) AS total FROM it),
b AS (SELECT grp, total, row_number() OVER (ORDER BY grp) - 1 AS r, count(*) OVER () AS n FROM (SELECT grp, any_value(total) AS total FROM cu GROUP BY grp)), pk AS (SELECT o_orderkey AS pick, b.grp, {UNIFORM('o_orderkey', '9')} * total AS place FROM orders JOIN b ON b.r = o_orderkey % 5)
SELECT pick, pk.grp, id FROM pk ASOF JOIN cu ON cu.grp = pk.grp AND pk.place >= cu.before""")
def f7_weighted_picks(spark, sf_dir):
    """Each order picks a part of one of five brands by weight, without a window over a brand."""
    items = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("weight"))
    brands = components.dense(items.where("weight > 0"), "grp").select(F.col("old").alias("grp"), (F.col("new") - 1).alias("r"))
    k = F.col("o_orderkey")
    picks = fx.table(spark, sf_dir, "orders").select(k.alias("pick"), draws.uniform(k, 9).alias("u"), (k % 5).alias("r")).join(F.broadcast(brands), "r").drop("r")
    return sampling.weighted_picks(items, picks).select("pick", "grp", "id")


@query(f"SELECT s_suppkey AS site_id, CAST(floor({UNIFORM('s_suppkey', '3')} * {W}) AS BIGINT) AS x, CAST(floor({UNIFORM('s_suppkey', '4')} * {W}) AS BIGINT) AS y FROM supplier")
def j7_random_cells(spark, sf_dir):
    """A random cell for each supplier; several may stand on one."""
    w, k = wh(spark, sf_dir)[0], F.col("s_suppkey")
    at = lambda stream: draws.uniform_int(draws.uniform(k, stream), 0, w - 1).cast("long")
    return fx.table(spark, sf_dir, "supplier").select(k.alias("site_id"), at(3).alias("x"), at(4).alias("y"))


#: Boxes from a thousandth of the segments' extent to all of it.
_BOXES = f"bx AS (SELECT box_id, x0, y0, x0 + s AS x1, y0 + s / 3 AS y1 FROM (SELECT s_suppkey AS box_id, {UNIFORM('s_suppkey', '5')} * 80 - 50 AS x0, {UNIFORM('s_suppkey', '6')} * 80 - 50 AS y0, 0.1 * pow(2.0, s_suppkey % 11) AS s FROM supplier))"


@query(f"""WITH {SEGMENTS}, {_BOXES}, t AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM seg, bx), u AS (SELECT *, greatest(0, coalesce(least((x0 - ax) / nullif(dx, 0), (x1 - ax) / nullif(dx, 0)), 0), coalesce(least((y0 - ay) / nullif(dy, 0), (y1 - ay) / nullif(dy, 0)), 0)) AS e,
least(1, coalesce(greatest((x0 - ax) / nullif(dx, 0), (x1 - ax) / nullif(dx, 0)), 1), coalesce(greatest((y0 - ay) / nullif(dy, 0), (y1 - ay) / nullif(dy, 0)), 1)) AS l FROM t)
SELECT id, box_id, round(ax + e * dx, 5) + 0.0 AS px, round(ay + e * dy, 5) + 0.0 AS py, round(ax + l * dx, 5) + 0.0 AS qx, round(ay + l * dy, 5) + 0.0 AS qy FROM u WHERE e <= l AND NOT (dx = 0 AND (ax < x0 OR ax > x1)) AND NOT (dy = 0 AND (ay < y0 OR ay > y1))""")
def d12_segments_in_boxes(spark, sf_dir):
    """Segments cut at many boxes of very unlike size."""
    k = F.col("s_suppkey")
    at = lambda stream: draws.uniform(k, stream) * 80 - 50
    side = 0.1 * F.pow(F.lit(2.0), k % 11)
    found = fx.table(spark, sf_dir, "supplier").select(k.alias("box_id"), at(5).alias("x0"), at(6).alias("y0"), side.alias("s")).select("box_id", "x0", "y0", (F.col("x0") + F.col("s")).alias("x1"), (F.col("y0") + F.col("s") / 3).alias("y1"))
    cut = boxes.segments_in_boxes(fx.segments(spark, sf_dir), found)
    return cut.select("id", "box_id", *((F.round(c, 5) + 0.0).alias(c) for c in ("px", "py", "qx", "qy")))
