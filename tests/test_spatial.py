"""Hand-checkable cases, and a few catalog queries against their SQL."""

import collections
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tessella import catalog
from tessella.functions import draws, geometry as g
from tessella.operators import boxes, components, growth, halfedges, lines, merging, nearest, raster, sampling, sitetree, voronoi
from tessella.sources import fixtures as fx, json_files as js

SF = "/root/testdata/sf0.001"


def test_torus_labels(spark):
    sites = spark.createDataFrame([(0, 1, 1), (1, 6, 6), (2, 1, 6)], "site_id bigint, sx bigint, sy bigint")
    rows = nearest.nearest(fx.grid(spark, 8), sites, 8, 8).collect()
    assert len(rows) == 64 and sum(r.label for r in rows) == 54


def test_bucket_search_agrees(spark):
    sites = spark.createDataFrame([(k, k * 37 % 50, k * 11 % 50) for k in range(40)], "site_id bigint, sx bigint, sy bigint")
    one = nearest.nearest(fx.grid(spark, 50), sites, 50, 50).collect()
    two = nearest._by_bucket(fx.grid(spark, 50), sites, 50, 50, 40).collect()
    assert sorted(one) == sorted(two)


def test_ring_area_and_roots(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3))])
    r = spark.range(1).select(g.ring_area(ring).alias("a"), g.in_ring(ring, F.lit(3.0), F.lit(1.0)).alias("i"), g.quadratic_roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)).alias("q")).first()
    assert r.a == -6 and r.i and r.q == [1.0, 2.0]


def test_two_halves(spark):
    grid = fx.grid(spark, 6).withColumn("label", (F.col("x") >= 3).cast("long"))
    assert raster.boundary_edges(grid, 6, 6).count() == 12
    assert components.regions(grid, 6, 6).select("region").distinct().count() == 2
    plain = fx.grid(spark, 6).withColumn("label", F.lit(1).cast("long"))
    assert raster.boundary_edges(plain, 6, 6).count() == 0 and components.regions(plain, 6, 6).select("region").distinct().count() == 1


def test_long_chain_is_one_component(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(e)
    assert found.count() == 201 and found.where("component <> 0").count() == 0


def test_cells_fill_the_square(spark):
    sites = spark.createDataFrame([(0, 2.0, 2.0), (1, 8.0, 3.0), (2, 5.0, 8.0)], "site_id bigint, sx double, sy double")
    c = voronoi.centroids(voronoi.cells(sites, 10.0)).collect()
    assert len(c) == 3 and math.isclose(sum(r.area for r in c), 100.0)


def test_lines_of_two_halves(spark):
    """Two closed lines around the torus, each of six steps, back at their first corner."""
    grid = fx.grid(spark, 6).withColumn("label", (F.col("x") >= 3).cast("long"))
    on = lines.ordered_lines(raster.boundary_edges(grid, 6, 6), 6, 6)
    rows = sorted((r.line, r.seq, r.x, r.y) for r in on.collect())
    assert len(rows) == 14 and len({r[0] for r in rows}) == 2
    for line in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == line]
        assert [r[0] for r in own] == list(range(7)) and own[0][1:] == own[-1][1:] and len({r[1] for r in own}) == 1
    assert lines.ordered_lines(raster.boundary_edges(grid.withColumn("label", F.lit(1)), 6, 6), 6, 6).count() == 0


def test_colours_are_greedy_in_a_random_order(spark):
    pairs = [(a, b) for a in range(30) for b in range(a) if (a * b + a) % 3 == 0]
    ids = spark.range(31).select(F.col("id").alias("line"))
    found = {r.line: r.colour for r in lines.colour(ids, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    order = [r.line for r in ids.orderBy(F.xxhash64("line", F.lit(1)), "line").collect()]
    want: dict = {}
    for k in order:
        used = {want[b if a == k else a] for a, b in pairs if k in (a, b) and (b if a == k else a) in want}
        want[k] = next(c for c in range(40) if c not in used)
    assert found == want
    assert lines.colour(ids.limit(0), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_regions_merge_to_a_number(spark):
    ids = spark.range(20).select(F.col("id").alias("label"))
    path = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(k, k + 1) for k in range(10, 19)], "a bigint, b bigint")
    for asked, left in ((25, 20), (7, 7), (1, 2)):
        rows = {r.label: r.region for r in merging.merge_regions(ids, path, asked).collect()}
        assert len(rows) == 20 and set(rows.values()) == set(range(1, left + 1)) and not {rows[k] for k in range(10)} & {rows[k] for k in range(10, 20)}
        assert all(len({rows[k] for k in range(a, b + 1)}) == 1 for a in range(20) for b in range(a, 20) if rows[a] == rows[b])


@pytest.mark.parametrize("block", [8, 4096])
def test_tree_of_merges(spark, block):
    """Blocks of any size give the merges of one after the other, and any number of them is looked up."""
    import random

    rng = random.Random(block)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)} | {(50, 51)})
    table = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:9]] + [(7, 7)], "a bigint, b bigint")
    weight = {(r.a, r.b): r.w for r in spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", merging.border_weight(1).alias("w")).collect()}
    name, want, seen = {v: v for v in range(52)}, [], {0: {v: v for v in range(52)}}
    for a, b in sorted(pairs, key=lambda p: (weight[p], p)):
        low, high = sorted((name[a], name[b]))
        if low != high:
            want.append((len(want) + 1, low, high))
            name = {v: low if n == high else n for v, n in name.items()}
            seen[len(want)] = name
    tree = merging.merge_tree(table, block=block)
    assert sorted(map(tuple, tree.collect())) == want
    asked = [0, 1, 5, len(want), 1000]
    ids = spark.range(52).select(F.col("id").alias("label"))
    found = merging.regions_after(ids, tree, asked)
    assert {tuple(r) for r in found.select("merges", "label", "region").collect()} == {(k, v, seen[min(k, len(want))][v]) for k in asked for v in range(52)}
    left = {(k, *sorted((seen[min(k, len(want))][a], seen[min(k, len(want))][b]))) for k in asked for a, b in pairs}
    assert sorted(map(tuple, merging.adjacency_after(spark.createDataFrame(pairs, "a bigint, b bigint"), found).collect())) == sorted(r for r in left if r[1] != r[2])
    if block == 8:
        merged = {r.label: r.region for r in merging.merge_regions(ids, table.where("a < b").distinct(), 45).collect()}
        assert all((merged[a] == merged[b]) == (seen[7][a] == seen[7][b]) for a in range(52) for b in range(52))
        assert merging.merge_tree(table.where("a = b")).count() == 0


@pytest.mark.parametrize("tile", [4, 8, 64])
@pytest.mark.parametrize("torus", [True, False])
def test_parts_in_tiles(spark, tile, torus):
    """Labels, walls and holes in the raster, over tiles that end within it, against a flood fill."""
    import random

    rng, w, h = random.Random(tile), 18, 13
    cells = {(m, x, y): (rng.randrange(2), rng.random() < 0.2, rng.random() < 0.2) for m in (0, 3) for x in range(w) for y in range(h) if rng.random() < 0.95}
    near = collections.defaultdict(set)
    for (m, x, y), (label, wx, wy) in cells.items():
        for wall, low, other in ((wx, x, (m, (x - 1) % w, y)), (wy, y, (m, x, (y - 1) % h))):
            if not wall and (torus or low > 0) and other in cells and cells[other][0] == label:
                near[(m, x, y)].add(other)
                near[other].add((m, x, y))
    want = {}
    for c in sorted(cells):
        stack = [c] if c not in want else []
        while stack:
            d = stack.pop()
            if d not in want:
                want[d] = (c[0] * w + c[1]) * h + c[2]
                stack += near[d]
    rows = spark.createDataFrame([(*c, *v) for c, v in cells.items()], "map_id long, x long, y long, label long, wx boolean, wy boolean")
    assert {(r.map_id, r.x, r.y): r.root for r in components.parts(rows, w, h, torus, tile).collect()} == want


def test_areas_with_and_without_wrap(spark):
    cells = fx.grid(spark, 4).withColumn("map_id", F.lit(3).cast("long"))
    wall = spark.createDataFrame([(3, 2, y, "low_x") for y in range(4)], "map_id bigint, x bigint, y bigint, side string")
    count = lambda s, t: merging.areas_between(cells, s, 4, 4, t).agg(F.countDistinct("region")).first()[0]
    assert count(wall, True) == 1 and count(wall, False) == 2 and count(wall.limit(0), True) == 1


def test_corners_beyond_32768(spark):
    """Keys of edges and corners tell places of large rasters apart."""
    far = 1 << 20
    square = lambda x, y: [(x, y, x + 1, y), (x, y + 1, x + 1, y + 1), (x, y, x, y + 1), (x + 1, y, x + 1, y + 1)]
    at = [(5, 7), (5 + (1 << 15), 7), (5, 7 + (1 << 15)), (far - 9, far - 9)]
    edges = spark.createDataFrame([(*e, 1, 2) for x, y in at for e in square(x, y)], "x1 bigint, y1 bigint, x2 bigint, y2 bigint, group_a bigint, group_b bigint")
    labels = components.label_edges(edges).groupBy("label").count().collect()
    assert [r["count"] for r in labels] == [4] * 4
    assert {(r.n_edges, r.closed) for r in components.polylines(edges, far, far).collect()} == {(4, True)}
    on = lines.ordered_lines(edges, far, far).collect()
    assert len(on) == 20 and {(r.x, r.y) for r in on} == {(x + i, y + j) for x, y in at for i in (0, 1) for j in (0, 1)}
    sides = lines.border_map(spark.createDataFrame(on), far, far).select("x", "y", "side").collect()
    assert len(sides) == 16


@pytest.mark.parametrize("layout", ["spread", "clustered", "lines", "spots", "circle"])
@pytest.mark.parametrize("weight", [None, "weight"])
def test_tiles_agree_with_all_pairs(spark, layout, weight):
    """Whatever the layout, and with far more sites in one tile than a leaf holds."""
    at = {"spread": lambda k: (k * 37 % 50, k * 11 % 48), "clustered": lambda k: (7 + k % 5, 9 + k % 7), "lines": lambda k: (k % 50, 20), "spots": lambda k: (k % 3 * 10, 5), "circle": lambda k: (round(25 + 20 * math.cos(k / 6)), round(24 + 20 * math.sin(k / 6)))}[layout]
    sites = spark.createDataFrame([(k, *at(k), 1.0 + k % 9 * 0.7) for k in range(60)], "site_id bigint, sx bigint, sy bigint, weight double")
    grid = fx.grid(spark, 50, 48)
    tiles = nearest.Tiles(sites, 50.0, 48.0, 3 if layout == "circle" else 5, weight)
    found = nearest.lookup(grid, tiles, "x", "y", lambda s, x, y: nearest._cost(s, 50, 48, weight, x, y)).select("x", "y", "best.id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, nearest._by_array(grid, sites, 50, 48, weight).collect()))


def test_clustered_sites(spark):
    """Many sites in one bucket: cells see their nearest neighbours first, and all of them if that does not settle it."""
    ring = [(k, 50 + 3 * math.cos(k / 5), 50 + 3 * math.sin(k / 5)) for k in range(31)] + [(100 + k, 50 + 0.001 * k, 50.0) for k in range(120)] + [(999, 1.0, 1.0)]
    sites = spark.createDataFrame(ring, "site_id bigint, sx double, sy double")
    rings = voronoi.staged(voronoi.cells(sites, 100.0))
    c = voronoi.centroids(rings).collect()
    assert len(c) == len(ring) and math.isclose(sum(r.area for r in c), 10_000, rel_tol=1e-9)
    e = {(r.site_id, x.e) for r in rings.collect() for x in r.ring if x.e >= 0}
    assert e == {(b, a) for a, b in e}
    assert voronoi.cells(sites.limit(0), 100.0).count() == 0


def test_documents_round_trip(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 7 / 4).alias("v"))
    js.write_vector(rows.repartition(5), f"{tmp_path}/v", ["id"], js.number_text(F.col("v"), True))
    assert [tuple(r) for r in js.read_vector(spark, f"{tmp_path}/v", "double").orderBy("at").collect()] == [(k, k % 7 / 4) for k in range(1000)]
    parts = sorted(f for f in os.listdir(f"{tmp_path}/v") if f.startswith("part-"))
    whole = json.loads("".join(open(f"{tmp_path}/v/{f}").read() for f in parts))
    assert whole == {"vector": [k % 7 / 4 for k in range(1000)]}
    js.write_vector(rows.limit(0), f"{tmp_path}/none", ["id"], js.number_text(F.col("v")))
    assert js.read_vector(spark, f"{tmp_path}/none").count() == 0
    with open(f"{tmp_path}/edges.json", "w") as f:  # as other programs write it, in one line
        f.write(' {"edges": [[[0, 1], [1, 1]], [[2, 2], [2, 3]]]}')
    assert [tuple(r) for r in js.read_edges(spark, f"{tmp_path}/edges.json").collect()] == [(0, 1, 1, 1), (2, 2, 2, 3)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Documents in a single line, cut into splits of a few hundred bytes, in element types of several depths."""
    vector, matrix = [k * 1.5 - 7 for k in range(3000)], [[x * 31 + y for y in range(40)] for x in range(60)]
    edges = [[[k, k + 1], [k + 2, 7]] for k in range(900)]
    for name, value in (("vector", vector), ("matrix", matrix), ("edges", edges), ("labelled_edges", [{"label": k, "vertices": e} for k, e in enumerate(edges)])):
        for layout, indent in (("line", None), ("pretty", 2)):
            with open(f"{tmp_path}/{name}-{layout}.json", "w") as f:
                json.dump({name: value}, f, indent=indent)
    with open(f"{tmp_path}/none.json", "w") as f:
        f.write('{ "vector" : [ ] }\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", ",").text(f"{tmp_path}/vector-line.json").rdd.getNumPartitions() > 10
        for layout in ("line", "pretty"):
            path = lambda name: f"{tmp_path}/{name}-{layout}.json"  # noqa: B023, E731
            assert [tuple(r) for r in js.read_vector(spark, path("vector"), "double").orderBy("at").collect()] == list(enumerate(vector))
            assert sorted(map(tuple, js.read_matrix(spark, path("matrix")).collect())) == [(x, y, v) for x, row in enumerate(matrix) for y, v in enumerate(row)]
            assert sorted(map(tuple, js.read_edges(spark, path("edges")).collect())) == sorted((*a, *b) for a, b in edges)
            assert sorted(map(tuple, js.read_labelled_edges(spark, path("labelled_edges")).collect())) == sorted((k, *a, *b) for k, (a, b) in enumerate(edges))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert js.read_vector(spark, f"{tmp_path}/none.json").count() == 0


def test_distributions(spark):
    """Means of draws, with means beyond 500 for Poisson and shapes that are not whole for Gamma; a distribution is any function of a key."""
    k = F.col("id") * 104_729 + 17
    made = {"small": draws.poisson(k, 3.5), "large": draws.poisson(k, 200.0), "parts": draws.poisson(k, 1300.0), "half": draws.gamma(k, 0.5, 2.0), "gamma": draws.Distribution(draws.gamma, 3.7, 1.5)(k), "die": draws.Distribution(draws.uniform_int, 1, 6)(k), "own": draws.Distribution(lambda key, a: draws.uniform(key) * a, 10.0)(k)}
    got = spark.range(20_000).select(*(v.alias(n) for n, v in made.items())).agg(*(F.avg(n).alias(n) for n in made), F.max("large").alias("top")).first()
    for n, mean in (("small", 3.5), ("large", 200.0), ("parts", 1300.0), ("half", 1.0), ("gamma", 5.55), ("die", 3.5), ("own", 5.0)):
        assert abs(got[n] - mean) < 0.05 * mean, (n, got[n])
    assert got.top > 220


def test_generator_is_the_same_in_sql(spark):
    """Keys of any sign and size, streams that are numbers or columns."""
    import duckdb

    keys = [0, 1, -1, 2**31, 2**32, 2**32 + 1, -(2**40) - 7, 2**62, -(2**62)]
    rows = spark.createDataFrame([(k, j) for k in keys for j in (0, 5, 2**33 + 1, -3)], "k bigint, j bigint")
    got = rows.select("k", "j", draws.bits(F.col("k"), F.col("j")).alias("b"), draws.bits(F.col("k"), 5).alias("five"), draws.uniform(F.col("k")).alias("u")).collect()
    for k, j, b, five, u in got:
        assert 0 <= b < 2**32 and 0 < u < 1 and (b == five) == (j == 5)
        assert duckdb.sql(f"select {draws.bits_sql(str(k), str(j))}, {draws.bits_sql(str(k), '5')}, {draws.uniform_sql(str(k))}").fetchall()[0] == (b, five, u)
    assert len({r.b for r in got}) == len(got)


def test_draws_are_independent(spark):
    """Means, variances and skewness of compound distributions, and correlations between neighbouring keys and streams."""
    k, n = F.col("id"), 60_000
    wanted = {  # mean, variance, skewness
        "uniform": (draws.uniform(k), 0.5, 1 / 12, 0.0), "normal": (draws.Distribution(draws.normal)(k), 0.0, 1.0, 0.0), "lognormal": (draws.Distribution(draws.lognormal, 0.0, 0.25)(k), math.exp(1 / 32), (math.exp(1 / 16) - 1) * math.exp(1 / 16), None),
        "exponential": (draws.exponential(draws.uniform(k), 2.0), 0.5, 0.25, 2.0), "chi_squared": (draws.chi_squared(k, 4), 4.0, 8.0, math.sqrt(2)), "long_chi_squared": (draws.chi_squared(k, 20), 20.0, 40.0, math.sqrt(8 / 20)),
        "binomial": (draws.binomial(k, 8, 0.4), 3.2, 1.92, 0.2 / math.sqrt(1.92)), "negative_binomial": (draws.negative_binomial(k, 3, 0.5), 3.0, 6.0, 1.5 / math.sqrt(1.5)), "geometric": (draws.geometric(draws.uniform(k), 0.3), 0.7 / 0.3, 0.7 / 0.09, 1.7 / math.sqrt(0.7)),
        "student_t": (draws.student_t(k, 9), 0.0, 9 / 7, None), "fisher_f": (draws.fisher_f(k, 3, 20), 20 / 18, 2 * 400 * 21 / (3 * 18**2 * 16), None), "poisson": (draws.poisson(k, 4.0), 4.0, 4.0, 0.5), "gamma": (draws.gamma(k, 2.5, 2.0), 5.0, 10.0, 2 / math.sqrt(2.5)),
        "piecewise_constant": (draws.Distribution(draws.piecewise_constant, [0.0, 1.0, 3.0, 6.0], [1, 1, 2])(k), 2.875, 0.25 / 3 + 0.25 * 13 / 3 + 0.5 * 21 - 2.875**2, None), "piecewise_linear": (draws.Distribution(draws.piecewise_linear, [0.0, 1.0, 2.0], [0.0, 1.0, 0.0])(k), 1.0, 1 / 6, 0.0),
    }
    rows = spark.range(n).select("id", *(c.cast("double").alias(name) for name, (c, *_) in wanted.items()), draws.uniform(k, 1).alias("v"), draws.uniform(k + 1).alias("after"), draws.uniform(k * 1_000_003 + 17, 2).alias("far"))
    rows = sampling.staged(rows)
    got = rows.agg(*(f(name).alias(f"{name}_{f.__name__}") for name in wanted for f in (F.avg, F.var_samp, F.skewness))).first()
    for name, (_, mean, variance, skew) in wanted.items():
        assert abs(got[f"{name}_avg"] - mean) < 5 * math.sqrt(variance / n), name
        assert abs(got[f"{name}_var_samp"] / variance - 1) < 0.08, (name, got[f"{name}_var_samp"], variance)
        assert skew is None or abs(got[f"{name}_skewness"] - skew) < 0.12, (name, got[f"{name}_skewness"])
    pairs = rows.agg(*(F.corr("uniform", c).alias(c) for c in ("v", "after", "far", "id")), F.corr(F.col("uniform") * F.col("uniform"), F.col("v") * F.col("v")).alias("squares")).first()
    assert all(abs(c) < 5 / math.sqrt(n) for c in pairs), pairs
    low = spark.range(n).select(*((F.pmod(F.shiftright(draws.bits(k), b), F.lit(2))).alias(f"b{b}") for b in range(32))).agg(*(F.avg(f"b{b}") for b in range(32))).first()
    assert all(abs(x - 0.5) < 0.5 * 5 / math.sqrt(n) for x in low)


def test_growth_follows_weights(spark):
    """Heavier seeds grow larger, the lowest label keeps a shared cell, and maps do not meet."""
    seeds = spark.createDataFrame([(m, k, 4 * k, 5, 9.0 if k == 1 else 1.0) for m in range(6) for k in range(4)] + [(0, 9, 0, 5, 1.0)], "map_id bigint, label bigint, x bigint, y bigint, weight double")
    grid = growth.grow(seeds, 16, 16)
    area = {(r.map_id, r.label): r["count"] for r in grid.groupBy("map_id", "label").count().collect()}
    assert sum(area.values()) == 6 * 256 and (0, 9) not in area and sum(area[(m, 1)] for m in range(6)) > 6 * 80


@pytest.mark.parametrize("size, stencil, share", [((7, 5), "reference", 0.9), ((2, 5), "moore", None), ((1, 1), "moore", None)])
def test_growth_in_the_order_of_times(spark, size, stencil, share):
    """Spans of any length against cells taken one at a time from a heap, on tori down to those where neighbours coincide."""
    import heapq

    w, h = size
    seeds = [(m, k, 5 * k + m, 2 * k * k, float(1 + (k * 7 + m) % 30)) for m in (0, 4) for k in range(4)] + [(9, 1, -1, h + 1, 2.0)]
    table = spark.createDataFrame(seeds, "map_id bigint, label bigint, x bigint, y bigint, weight double")
    got = growth.grow(table, w, h, 3, stencil, share).collect()
    cells = spark.range(w * h).select(F.floor(F.col("id") / h).alias("i"), (F.col("id") % h).alias("j"))
    delay = {tuple(r)[:4]: r.t for r in table.join(cells).select("map_id", "label", "i", "j", growth._delay(F.col("map_id"), F.col("label"), F.col("i"), F.col("j"), F.col("weight"), 3).alias("t")).collect()}
    moves = set(raster.REFERENCE if stencil == "reference" else raster.MOORE)
    heap, want = [(0, label, m, x % w, y % h) for m, label, x, y, _ in seeds], {}
    heapq.heapify(heap)
    while heap:
        at, label, m, x, y = heapq.heappop(heap)
        if (m, x, y) not in want:
            want[m, x, y] = label
            for i, j in moves:
                to = (x + i) % w, (y + j) % h
                heapq.heappush(heap, (at + delay[m, label, *to], label, m, *to))
    assert len(got) == 3 * w * h and {(r.map_id, r.x, r.y): r.label for r in got} == want
    assert growth.grow(table.where("false"), w, h).count() == 0


def test_walks_end_where_earlier_ones_have_been(spark):
    """The set-based ends against one walk after the other."""
    maps = spark.createDataFrame([(0,), (3,)], "map_id bigint")
    steps = growth.paths(maps, 12, 12, 4, 60, 0.3, 5).collect()
    want = set()
    for m in (0, 3):
        seen: set = set()
        for walk in range(8):
            own = [(r.x, r.y) for r in sorted((r for r in steps if (r.map_id, r.walk) == (m, walk)), key=lambda r: r.step)]
            before = {c for c, w in seen if w // 2 != walk // 2} | {c for c, w in seen if w // 2 == walk // 2 and c != own[0]}
            if own[0] in before:
                continue
            been = [own[0]]
            for c in own[1:]:
                want.add((m, walk // 2 + 1, *sorted((been[-1], c))))
                stop = c in before or c in been or c in {d for d, w in seen}
                been.append(c)
                if stop:
                    break
            seen |= {(c, walk) for c in been}
    got = growth.walk_cuts(maps, 12, 12, 4, 0.3, 5, 60).collect()
    ends = lambda r: sorted(((r.x, r.y), ((r.x + 1) % 12, r.y) if r.side == "low_y" else (r.x, (r.y + 1) % 12)))
    first: dict = {}
    for m, cut, a, b in sorted(want):
        first[(m, a, b)] = min(first.get((m, a, b), cut), cut)
    assert {(r.map_id, *ends(r)): r.cut for r in got} == first


def test_half_edges_of_two_squares(spark):
    """Two squares side by side and a bar that ends inside one: faces, their order, areas and what they share."""
    edges = [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0), (2, 0, 4, 0), (4, 0, 4, 2), (4, 2, 2, 2), (0, 0, 1, 1)]
    rows = spark.createDataFrame([tuple(map(float, e)) for e in edges + edges[:2]] + [(1.0, 1.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    found = halfedges.faces(halfedges.half_edges(rows))
    own = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.face, r.seq)):
        own[r.face].append(r)
    assert len(own) == 3 and sum(map(len, own.values())) == 16
    for ring in own.values():
        assert [r.seq for r in ring] == list(range(len(ring))) and all((a.tx, a.ty, a.next) == (b.x, b.y, b.id) for a, b in zip(ring, ring[1:] + ring[:1]))
    assert sorted((r.n_edges, r.area) for r in halfedges.outlines(found).collect()) == [(4, 4.0), (6, -8.0), (6, 4.0)]
    assert halfedges.neighbours(found).count() == 3
    cut = halfedges.crop(rows, 1.0, 3.0)
    areas = sorted(r.area for r in halfedges.outlines(halfedges.faces(halfedges.half_edges(cut))).collect())
    assert areas == [-4.0, 1.0, 1.0, 2.0] and halfedges.crop(rows.limit(0), 1.0, 3.0).count() == 4


def test_sites_in_a_row_and_on_a_circle(spark):
    """The nearest site of points through the tree, against all pairs, for layouts with many sites at nearly one distance."""
    row = [(k, 2.0 * k, 100.0) for k in range(200)]
    ring = [(1000 + k, 500 + 300 * math.cos(k), 500 + 300 * math.sin(k)) for k in range(100)]
    knot = [(2000 + k, 700 + 1e-7 * k, 700.0) for k in range(60)]
    for sites in (row, ring, row + ring + knot, row[:1]):
        table = spark.createDataFrame(sites, "site_id bigint, sx double, sy double")
        points = [(k, k * 37.5 % 1000, k * 91.25 % 1000) for k in range(60)] + [(99, 500.0, 500.0), (100, 0.0, 1000.0)]
        tree = sitetree.SiteTree(table, 1000.0)
        got = tree.nearest(spark.createDataFrame(points, "id bigint, px double, py double").withColumn("reach", F.lit(1e12)), ["id"], "px", "py", "reach").collect()
        want = {i: min(((x - px) * (x - px) + (y - py) * (y - py), k) for k, x, y in sites) for i, px, py in points}
        assert {r.id: (r.best.d, r.best.site_id) for r in got} == want and all(r.closer for r in got)


def test_cells_by_tiles_and_by_tree(spark, monkeypatch):
    """Even sites need no tree; with tiles too small or too full for some cells, the tree gives the same cells."""
    import random

    rng = random.Random(4)
    rows = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(150)] + [(150 + k, rng.uniform(70, 71), rng.uniform(20, 21)) for k in range(30)]
    sites = spark.createDataFrame(rows, "site_id bigint, sx double, sy double")
    found = lambda: {r.site_id: ({(round(p.x, 6), round(p.y, 6)) for p in r.ring}, {p.e for p in r.ring}) for r in voronoi.cells(sites, 100.0).collect()}
    monkeypatch.setattr(voronoi, "CROWD", 12)
    monkeypatch.setattr(voronoi, "TILES", (2, 5))
    small = found()
    monkeypatch.undo()
    monkeypatch.setattr(voronoi, "SiteTree", None)
    assert found() == small and len(small) == 180


def test_box_pairs(spark):
    """Boxes from points to the whole extent, touching ones and some that are null or turned inside out, against all pairs."""
    import random

    rng = random.Random(3)

    def some(n, big):
        out = []
        for k in range(n):
            x, y, s = rng.uniform(0, 64), rng.uniform(0, 64), rng.choice([0, 0.01, 1, 7, big])
            x, y = (float(int(x)), float(int(y))) if k % 3 == 0 else (x, y)
            out.append((k, x, y, x + s, y + s * rng.random()))
        return out + [(n, None, 1.0, 2.0, 3.0), (n + 1, 5.0, 5.0, 4.0, 6.0)]

    left, right = some(80, 30), some(60, 100)
    want = {(a[0], b[0]) for a in left[:80] for b in right[:60] if max(a[1], b[1]) <= min(a[3], b[3]) and max(a[2], b[2]) <= min(a[4], b[4])}
    tables = [spark.createDataFrame(rows, f"{name} bigint, x0 double, y0 double, x1 double, y1 double") for rows, name in ((left, "id"), (right, "other"))]
    got = [tuple(r) for r in boxes.box_pairs(*tables).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 200
    assert boxes.box_pairs(tables[0].limit(0), tables[1].limit(0)).count() == 0 and boxes.box_pairs(tables[0].limit(0), tables[1]).count() == 0


def test_box_pairs_of_crowded_cells(spark, monkeypatch):
    """Cells with many boxes are joined in blocks, and small boxes are not paired in the cells of large ones."""
    import random

    rng = random.Random(3)
    some = lambda n: [(k, *(a := (rng.uniform(0, 10), rng.uniform(0, 10))), *(c + (9 if k % 5 == 0 else 0.05) for c in a)) for k in range(n)]
    left, right = some(150), some(170)
    want = {(a[0], b[0]) for a in left for b in right if max(a[1], b[1]) <= min(a[3], b[3]) and max(a[2], b[2]) <= min(a[4], b[4])}
    met, blocked = [], boxes._blocked

    def counted(one, two):
        out = blocked(one, two)
        met.append(out.count())
        return out

    monkeypatch.setattr(boxes, "BLOCK", 8)
    monkeypatch.setattr(boxes, "_blocked", counted)
    tables = [spark.createDataFrame(rows, f"{name} bigint, x0 double, y0 double, x1 double, y1 double") for rows, name in ((left, "id"), (right, "other"))]
    got = [tuple(r) for r in boxes.box_pairs(*tables).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(met) < 4 * (30 * 170 + 34 * 150)


def test_fill_grows_from_a_point(spark):
    """From one point over the whole square: least distance, no place out of reach, and the same again."""
    start = spark.createDataFrame([(5, 0.03, 0.04), (9, 0.05, 0.05), (11, 1.5, 0.5)], "id bigint, px double, py double")
    kept = sampling.fill(start, 0.2).collect()
    at = {(r.px, r.py) for r in kept}
    assert (0.03, 0.04) in at and len(at) == len(kept) >= 14 and all(0 <= c <= 1 for p in at for c in p)
    assert all(a == b or math.dist(a, b) >= 0.2 for a in at for b in at)
    assert all(min(math.dist((i / 20, j / 20), p) for p in at) < 0.4 for i in range(21) for j in range(21))
    assert at == {(r.px, r.py) for r in sampling.fill(start, 0.2).collect()}
    assert sampling.fill(start.limit(0), 0.2).count() == 0


def test_poisson_disk_stages_no_pairs(spark, monkeypatch):
    """Dense points, a spot taken twice, points without a place: as thrown one by one, and no stage has more rows than there are points."""
    import random

    rng = random.Random(5)
    rows = [(k, rng.uniform(-1, 1), rng.uniform(0, 2) if k % 3 else rng.uniform(0, 0.1)) for k in range(1500)]
    rows += [(1500, rows[7][1], rows[7][2]), (1501, None, 1.0)]
    staged, sizes = sampling.staged, []

    def counted(df, name="stage"):
        out = staged(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(sampling, "staged", counted)
    got = [r.id for r in sampling.poisson_disk(spark.createDataFrame(rows, "id bigint, px double, py double"), 0.3).collect()]
    kept = []
    for k, x, y in rows[:1500]:
        if all((x - u) ** 2 + (y - v) ** 2 >= 0.3 * 0.3 for _, u, v in kept):
            kept.append((k, x, y))
    assert sorted(got) == [k for k, _, _ in kept] + [1501]
    assert max(sizes) <= len(rows)


def test_close_pairs_of_many_points(spark, monkeypatch):
    """Many points are not collected for a broadcast; crowded buckets are met in blocks, every pair once."""
    import random

    many = spark.range(5000).select("id", (F.col("id") / 9.0).alias("px"), (F.col("id") % 7 / 1.0).alias("py"))
    assert "Broadcast" not in sampling.close_pairs(many, many, 1.5)._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(11)
    rows = [(k, rng.uniform(0, 3), rng.uniform(0, 3)) if k % 2 else (k, rng.uniform(1.1, 1.3), rng.uniform(1.1, 1.3)) for k in range(300)]
    points = spark.createDataFrame(rows, "id bigint, px double, py double")
    monkeypatch.setattr(sampling, "FEW", 50)
    monkeypatch.setattr(sampling, "BLOCK", 16)
    got = [tuple(r) for r in sampling.close_pairs(points, points, 0.4).collect()]
    want = {(a, b) for a, x, y in rows for b, u, v in rows if a != b and (x - u) * (x - u) + (y - v) * (y - v) < 0.4 * 0.4}
    assert len(got) == len(want) and set(got) == want


def test_picks_without_a_window_of_a_group(spark):
    """Groups of very unlike size, weights of 0, groups without weight, over more partitions than groups."""
    import bisect
    import itertools

    items = [(g, k, (k * 7 + g) % 5) for g, n in ((0, 500), (1, 3), (2, 1), (4, 40)) for k in range(n)] + [(3, 1, 0)]
    picks = [(g, k, (k + 0.5) / 50) for g in range(6) for k in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sampling.weighted_picks(spark.createDataFrame(items, "grp int, id bigint, weight int"), spark.createDataFrame(picks, "grp int, pick bigint, u double")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for g in range(6):
        own = [(k, w) for h, k, w in items if h == g and w > 0]
        ends = list(itertools.accumulate(w for _, w in own))
        want |= {(g, p): own[bisect.bisect_right(ends, u * ends[-1])][0] for h, p, u in picks if h == g and own}
    assert {(r.grp, r.pick): r.id for r in got} == want


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tessella.plans import stage

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        stage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://one:7077", getConf=lambda: conf)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = c.sql(catalog.oracle_sql()[name])
    cols = sorted(want.columns)
    got = catalog.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)


@pytest.mark.parametrize("name", ["a1_point_text", "d1_areas", "d2_weighted_nearest", "e11_adjacency"])
def test_rasters_against_sql_at_another_scale(spark, name):
    import duckdb

    there = "/root/testdata/sf0.1"
    c = duckdb.connect()
    for f in os.listdir(there):
        c.execute(f"create view {f[:-8]} as select * from '{there}/{f}'")
    want = c.sql(catalog.oracle_sql()[name])
    cols = sorted(want.columns)
    got = catalog.queries()[name](spark, there).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
