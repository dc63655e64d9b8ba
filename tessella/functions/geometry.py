"""Plane and torus geometry as Column expressions; nothing leaves generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(v: Column, size: int) -> Column:
    """v modulo size, never negative."""
    return F.pmod(v, F.lit(size))


def axis_distance(a: Column, b: Column, size: int) -> Column:
    """Distance on a ring of so many cells, for coordinates in range."""
    d = F.abs(a - b)
    return F.least(d, F.lit(size) - d)


def sq_torus(ax, ay, bx, by, w: int, h: int) -> Column:
    dx, dy = axis_distance(ax, bx, w), axis_distance(ay, by, h)
    return dx * dx + dy * dy


def euclidean(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def centroid(a, b, c) -> tuple[Column, Column]:
    return (a[0] + b[0] + c[0]) / 3.0, (a[1] + b[1] + c[1]) / 3.0


def circumcenter(a, b, c) -> tuple[Column, Column]:
    """Centre of the circle through three points, from a 2x2 system with one division; null if collinear."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    u, v = ux * ux + uy * uy, vx * vx + vy * vy
    inverse = F.try_divide(F.lit(0.5), (ux * vy - uy * vx).cast("double"))
    return a[0] + (vy * u - uy * v) * inverse, a[1] + (ux * v - vx * u) * inverse


def bisector_center(a, b, c) -> tuple[Column, Column]:
    """The same where two perpendicular bisectors meet; null where a chord is horizontal or both are parallel."""
    def line(p, q):
        slope = F.try_divide((p[0] - q[0]).cast("double"), (q[1] - p[1]).cast("double"))
        return slope, (p[1] + q[1]) / 2.0 - slope * (p[0] + q[0]) / 2.0

    (m, k), (n, j) = line(a, b), line(b, c)
    x = F.try_divide(j - k, m - n)
    return x, m * x + k


def between_open(x, a, b) -> Column:
    return (x > F.least(a, b)) & (x < F.greatest(a, b))


def between_closed(x, a, b) -> Column:
    return (x >= F.least(a, b)) & (x <= F.greatest(a, b))


def lines_meet(a, b, c, d) -> tuple[Column, Column]:
    """Where the infinite lines ab and cd meet, by determinants; null if parallel."""
    det = (a[0] - b[0]) * (c[1] - d[1]) - (a[1] - b[1]) * (c[0] - d[0])
    p, q = a[0] * b[1] - a[1] * b[0], c[0] * d[1] - c[1] * d[0]
    return F.try_divide(p * (c[0] - d[0]) - (a[0] - b[0]) * q, det), F.try_divide(p * (c[1] - d[1]) - (a[1] - b[1]) * q, det)


def segments_meet(a, b, c, d) -> Column:
    x, y = lines_meet(a, b, c, d)
    hit = between_closed(x, a[0], b[0]) & between_closed(x, c[0], d[0]) & between_closed(y, a[1], b[1]) & between_closed(y, c[1], d[1])
    return F.coalesce(hit, F.lit(False))


def quadratic_roots(a, b, c, eps: float = 1e-10) -> Column:
    """Array of no, one or two roots, ascending; a is not 0."""
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    two = F.array_sort(F.array((-b - root) / (2 * a), (-b + root) / (2 * a)))
    return F.when(disc < -eps, F.array().cast("array<double>")).when(disc <= eps, F.array(-b / (2 * a))).otherwise(two)


def parabola_x(directrix, fx, fy, y) -> Column:
    """x of the point at height y that is as far from the focus as from the vertical directrix."""
    return ((y - fy) * (y - fy) + fx * fx - directrix * directrix) / (2 * (fx - directrix))


def _break(directrix, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """Coefficients of the quadratic in y of two parabolas over one directrix."""
    p, q = ax - directrix, bx - directrix
    return bx - ax, 2.0 * (by * p - ay * q), ay * ay * q - by * by * p - (bx - ax) * p * q


def break_y(directrix, ax, ay, bx, by) -> Column:
    """Height of the break point of two arcs, in the order of their foci: the lower one if the first focus lies farther along x, else the higher one."""
    a, b, c = _break(directrix, ax, ay, bx, by)
    roots = quadratic_roots(a, b, c)
    return F.when(a == 0, (ay + by) / 2.0).when(ax > bx, F.array_min(roots)).otherwise(F.array_max(roots))


def break_point(directrix, ax, ay, bx, by, eps: float = 1e-8) -> tuple[Column, Column]:
    """The break point of two arcs; of a focus on the directrix the arc is a ray at its height. Null where they do not meet."""
    on_a, on_b = F.abs(ax - directrix) < eps, F.abs(bx - directrix) < eps
    y = F.when(on_a, ay).when(on_b, by).otherwise(break_y(directrix, ax, ay, bx, by))
    return F.when(on_a, parabola_x(directrix, bx, by, y)).otherwise(parabola_x(directrix, ax, ay, y)), y


def break_between(directrix, ax, ay, bx, by) -> Column:
    """The height, of those where two parabolas meet, that lies strictly between the foci; else the one of the quadratic's positive root."""
    a, b, c = _break(directrix, ax, ay, bx, by)
    roots = quadratic_roots(a, b, c, 0.0)
    minus, plus = F.when(a > 0, F.get(roots, F.lit(0))).otherwise(F.get(roots, F.size(roots) - 1)), F.when(a > 0, F.get(roots, F.size(roots) - 1)).otherwise(F.get(roots, F.lit(0)))
    return F.when((F.size(roots) == 2) & between_open(minus, ay, by), minus).otherwise(plus)


def parabola_line(directrix, fx, fy, xs: Column) -> Column:
    """The parabola's points (x, y) at the given xs, ascending: lower branch in their order, vertex, upper branch backwards."""
    def ys(x):
        return quadratic_roots(F.lit(1.0), -2.0 * fy, fx * fx + fy * fy - directrix * directrix + 2.0 * x * (directrix - fx), 0.0)

    def branch(n, at):
        return F.transform(F.filter(xs, lambda x: F.size(ys(x)) == n), lambda x: F.struct(x.cast("double").alias("x"), F.get(ys(x), F.lit(at)).alias("y")))

    return F.concat(branch(2, 0), branch(1, 0), F.reverse(branch(2, 1)))


def parabola_meet_y(directrix, ax, ay, bx, by) -> Column:
    """Heights, ascending, where the parabolas of two foci over one directrix meet."""
    p, q = 2 * (ax - directrix), 2 * (bx - directrix)
    a, b = q - p, 2 * (by * p - ay * q)
    c = q * (ay * ay + ax * ax - directrix * directrix) - p * (by * by + bx * bx - directrix * directrix)
    return F.when(a == 0, F.array(F.try_divide(-c, b))).otherwise(quadratic_roots(a, b, c))


def outcode(x, y, lo, hi) -> Column:
    """Region of a point against the square [lo, hi]: left 1, right 2, bottom 4, top 8."""
    side = F.when(x < lo, 1).when(x > hi, 2).otherwise(0)
    return side + F.when(y < lo, 4).when(y > hi, 8).otherwise(0)


def clip(a, b, lo: float, hi: float) -> tuple[Column, Column, Column]:
    """Visible part of a segment in the square: whether there is one, and its ends as parameters from a to b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for d, p in ((dx, a[0]), (dy, a[1])):
        t, u = F.try_divide(F.lit(lo) - p, d), F.try_divide(F.lit(hi) - p, d)
        enter = F.greatest(enter, F.coalesce(F.least(t, u), F.lit(0.0)))
        leave = F.least(leave, F.coalesce(F.greatest(t, u), F.lit(1.0)))
        outside = outside | ((d == 0) & ((p < lo) | (p > hi)))
    return ~outside & (enter <= leave), enter, leave


def ring_area(ring: Column) -> Column:
    """Shoelace area of an open ring of structs (x, y): negative for counter-clockwise rings."""
    at = F.sequence(F.lit(0), F.size(ring) - 1)

    def term(acc, i):
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        return acc + (q["x"] * p["y"] - p["x"] * q["y"])

    return F.aggregate(at, F.lit(0.0), term) / 2.0


def in_ring(ring: Column, x, y) -> Column:
    """Even-odd test against an open ring; rings of under three vertices hold nothing."""
    at = F.sequence(F.lit(0), F.size(ring) - 1)

    def crosses(acc, i):
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        cut = (p["y"] > y) != (q["y"] > y)
        return acc + F.when(cut & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return (F.size(ring) >= 3) & (F.aggregate(at, F.lit(0), crosses) % 2 == 1)


def rotate(x, y, angle) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Shoelace centroid of an open ring of structs (x, y); null for a ring without area."""
    at = F.sequence(F.lit(0), F.size(ring) - 1)

    def fold(value):
        def term(acc, i):
            p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
            return acc + value(p, q) * (p["x"] * q["y"] - q["x"] * p["y"])

        return F.aggregate(at, F.lit(0.0), term)

    k = 3 * fold(lambda p, q: F.lit(1.0))
    return F.try_divide(fold(lambda p, q: p["x"] + q["x"]), k), F.try_divide(fold(lambda p, q: p["y"] + q["y"]), k)


def ray_exit(p, d, lo: float, hi: float) -> tuple[Column, Column]:
    """Where a ray from a point in the square [lo, hi] along d leaves it; null if d is zero."""
    side = lambda a, v: F.when(v > 0, F.try_divide(F.lit(hi) - a, v)).when(v < 0, F.try_divide(F.lit(lo) - a, v))
    t = F.least(side(p[0], d[0]), side(p[1], d[1]))
    return p[0] + t * d[0], p[1] + t * d[1]


def perimeter_at(x, y, lo, hi) -> Column:
    """Place of a point on the square's border: the left side downwards, then bottom, right and top; null inside."""
    n = hi - lo
    return F.when(x == lo, hi - y).when(y == lo, n + x - lo).when(x == hi, 2 * n + y - lo).when(y == hi, 3 * n + hi - x)


def outside_box(x, y, lo, hi) -> Column:
    return (x < lo) | (x > hi) | (y < lo) | (y > hi)


def inside_box(x, y, lo, hi) -> Column:
    """Inside the square or on its border."""
    return (x >= lo) & (x <= hi) & (y >= lo) & (y <= hi)


def interior_of_box(x, y, lo, hi) -> Column:
    return (x > lo) & (x < hi) & (y > lo) & (y < hi)


def complementary(slot) -> Column:
    """The slot of an edge at its other end: 0 and 1, 2 and 3 belong together."""
    return slot.bitwiseXOR(F.lit(1))


def point_hash(x, y) -> Column:
    """x and y below 2^31 in one long."""
    return x.cast("long") * F.lit(1 << 31) + y.cast("long")


def ring_of(points: list) -> tuple[Column, Column, Column]:
    """Double area (negative for counter-clockwise), and centroid, of a ring of a fixed number of (x, y): plain columns, no fold."""
    pairs = list(zip(points, points[1:] + points[:1]))
    cross = [p[0] * q[1] - q[0] * p[1] for p, q in pairs]
    k = sum(cross[1:], cross[0])
    x, y = (sum(((p[i] + q[i]) * c for (p, q), c in zip(pairs[1:], cross[1:])), (pairs[0][0][i] + pairs[0][1][i]) * cross[0]) for i in (0, 1))
    return -k, F.try_divide(x, 3 * k), F.try_divide(y, 3 * k)


def in_fixed_ring(points: list, x, y) -> Column:
    """in_ring() for a ring of a fixed number of (x, y): plain columns, no fold."""
    if len(points) < 3:
        return F.lit(False)
    hits = F.lit(0)
    for p, q in zip(points, points[1:] + points[:1]):
        cut = (p[1] > y) != (q[1] > y)
        hits = hits + F.when(cut & (x < (q[0] - p[0]) * F.try_divide(y - p[1], q[1] - p[1]) + p[0]), 1).otherwise(0)
    return hits % 2 == 1


def apart(ax, ay, bx, by) -> Column:
    """Whether two cells are neither the same nor neighbours, diagonals included."""
    return F.greatest(F.abs(ax - bx), F.abs(ay - by)) > 1


def chance(cost, last, k: float) -> Column:
    """Metropolis probability of a step from cost last to cost."""
    return F.exp(k * (last - cost))
