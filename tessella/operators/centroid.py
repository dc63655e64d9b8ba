"""Centroids on a torus: the exact optimum, and a Metropolis chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import chance
from tessella.plans.stage import staged


def axis_costs(points: DataFrame, key: str, axis: str, size: int) -> DataFrame:
    """(key, at, cost): summed squared ring distance of the key's coordinates from each place on the axis.

    Points are counted for each coordinate; running sums of n, n * v and n * v * v
    over the ring then give every place's cost from two of their rows: the
    coordinates up to half a ring on either side count as they are, those beyond it
    moved by a ring. A key has one row for each place, whatever its points.
    """
    counts = points.groupBy(key, F.pmod(F.col(axis), F.lit(size)).cast("long").alias("at")).agg(F.count("*").alias("n"))
    places = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("at"))
    row, at, n = Window.partitionBy(key).orderBy("at"), F.col("at"), F.coalesce("n", F.lit(0))
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    full = places.join(counts, [key, "at"], "left").select(key, "at", *(F.sum(v).over(upto).alias(f"s{k}") for k, v in enumerate((n, n * at, n * at * at))))
    whole, far = Window.partitionBy(key), size // 2
    # high: sums up to at + far; low: sums below at - far, which are none where that is below 0.
    sums = full.select(key, "at", *(c for k in range(3) for c in (F.max(f"s{k}").over(whole).alias(f"t{k}"), F.lead(f"s{k}", far).over(row).alias(f"h{k}"), F.coalesce(F.lag(f"s{k}", far + 1).over(row), F.lit(0)).alias(f"l{k}"))))
    sums = sums.select(key, "at", *(c for k in range(3) for c in (F.col(f"t{k}"), F.coalesce(f"h{k}", f"t{k}").alias(f"h{k}"), F.col(f"l{k}"))))

    def squares(k0, k1, k2, moved):
        a = F.col("at") + moved
        return k2 - 2 * a * k1 + a * a * k0

    part = lambda f: [f(k) for k in range(3)]
    near = squares(*part(lambda k: F.col(f"h{k}") - F.col(f"l{k}")), 0)
    above = squares(*part(lambda k: F.col(f"t{k}") - F.col(f"h{k}")), size)
    below = squares(*part(lambda k: F.col(f"l{k}")), -size)
    return sums.select(key, "at", (near + above + below).alias("cost"))


def exact(points: DataFrame, key: str, w: int, h: int) -> DataFrame:
    """(key, cx, cy, cost): the cell of least summed squared torus distance, lowest x and y on ties; the cost is one over x plus one over y."""
    out = None
    for axis, size in (("x", w), ("y", h)):
        best = axis_costs(points, key, axis, size).groupBy(key).agg(F.min(F.struct("cost", "at")).alias("b")).select(key, F.col("b.at").alias(f"c{axis}"), F.col("b.cost").alias(f"cost_{axis}"))
        out = best if out is None else out.join(best, key)
    return out.select(key, "cx", "cy", (F.col("cost_x") + F.col("cost_y")).alias("cost"))


#: Fixed values of the chain's linear sequence of states: modulus, multiplier, increment.
MODULUS, MULTIPLIER, INCREMENT = 2147483648, 1103515245, 12345


def _next(state):
    return (F.pmod(state, F.lit(MODULUS)) * F.lit(MULTIPLIER) + F.lit(INCREMENT)) % F.lit(MODULUS)


def chain(points: DataFrame, key: str, order: str, w: int, h: int, steps: int = 200, k: float = 2.0, seed: int = 1) -> DataFrame:
    """(key, cx, cy, cost, visits, costs): a Metropolis chain for each key, as one fold over its two tables of costs.

    It starts at the whole midpoint of the key's two first points (a single point is
    its own), steps to one of the four neighbours, kept inside the grid, when that
    costs less, or by chance, and returns its last cell with the cells that it has
    visited and their costs. Its states are a linear sequence, one after the other.
    """
    first = points.groupBy(key).agg(F.min(F.struct(order, "x", "y")).alias("p"))
    second = points.join(first, key).where(F.col(order) > F.col(f"p.{order}")).groupBy(key).agg(F.min(F.struct(order, "x", "y")).alias("q"))
    start = first.join(second, key, "left").select(key, *(F.floor((F.col(f"p.{c}") + F.coalesce(f"q.{c}", f"p.{c}")) / 2).cast("long").alias(f"s{c}") for c in "xy"))
    for axis, size in (("x", w), ("y", h)):
        table = axis_costs(points, key, axis, size).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cost"))), lambda c: c["cost"]).alias(f"k{axis}"))
        start = start.join(table, key)
    start = staged(start)
    cost = lambda x, y: F.get("kx", x.cast("int")) + F.get("ky", y.cast("int"))
    cell = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("cost"))
    begin = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), cost(F.col("sx"), F.col("sy")).alias("cost"), F.pmod(F.col(key) * 7919 + seed, F.lit(MODULUS)).alias("state"), F.array(cell(F.col("sx"), F.col("sy"), cost(F.col("sx"), F.col("sy")))).alias("seen"))

    def step(s, _):
        state = _next(s["state"])
        way = F.floor(state / F.lit(MODULUS / 4))
        x = F.greatest(F.lit(0), F.least(F.lit(w - 1), s["x"] + F.when(way == 0, -1).when(way == 1, 1).otherwise(0))).cast("long")
        y = F.greatest(F.lit(0), F.least(F.lit(h - 1), s["y"] + F.when(way == 2, -1).when(way == 3, 1).otherwise(0))).cast("long")
        return _moved(s, x, y, cost(x, y), _next(state), k)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step)
    out = start.select(key, done.alias("s")) if steps else start.select(key, begin.alias("s"))
    return out.select(key, F.col("s.x").alias("cx"), F.col("s.y").alias("cy"), F.col("s.cost").alias("cost"), F.transform("s.seen", lambda c: F.struct(c["x"], c["y"])).alias("visits"), F.transform("s.seen", lambda c: c["cost"]).alias("costs"))


def _moved(s, x, y, c, state, k):
    u = (state + 0.5) / float(MODULUS)
    go = ((x != s["x"]) | (y != s["y"])) & ((c < s["cost"]) | (u < chance(c.cast("double"), s["cost"].cast("double"), k)))
    pick = lambda a, b: F.when(go, a).otherwise(b)
    seen = F.when(go, F.concat(s["seen"], F.array(F.struct(x.alias("x"), y.alias("y"), c.alias("cost"))))).otherwise(s["seen"])
    return F.struct(pick(x, s["x"]).alias("x"), pick(y, s["y"]).alias("y"), pick(c, s["cost"]).alias("cost"), state.alias("state"), seen.alias("seen"))
