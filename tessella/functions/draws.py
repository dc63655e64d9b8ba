"""A portable counter-based generator and distributions by inverse CDF, as Column expressions.

A draw is a function of a key and a stream, so that any row has as many independent
draws as it needs, whatever the order in which rows are met. Key and stream go into
two linear words, which xor-shift-multiply rounds mix and which are then joined: no
draw is a shift of another one's. All products stay below 2^63, so engines whose
whole numbers do not wrap agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
MODULUS = 1 << 32
_MASK = MODULUS - 1
#: Odd multipliers below 2^31 for the low and high word of the key and for the stream, with an offset, one row for each word.
WORDS = ((1540483477, 461845907, 374761393, 1013904223), (668265263, 739982445, 695872825, 374440041))
#: Fixed values of the mixing rounds: shift, multiplier; the last shift has none.
ROUNDS, LAST = ((16, 569420461), (15, 1935289751)), 15


def bits(key: Column, stream: Column | int = 0) -> Column:
    """A whole number below 2^32 for a key, of any sign, and a stream; streams count modulo 2^32."""
    low = lambda v: v.cast("long").bitwiseAND(F.lit(_MASK))
    high = F.shiftrightunsigned(key.cast("long"), 32)
    out = None
    for k_low, k_high, k_stream, offset in WORDS:
        moved = F.lit((stream & _MASK) * k_stream + offset & _MASK) if isinstance(stream, int) else low(low(stream) * k_stream + offset)
        word = low(low(low(key) * k_low) + low(high * k_high) + moved)
        for shift, by in ROUNDS:
            word = low(word.bitwiseXOR(F.shiftright(word, shift)) * by)
        word = word.bitwiseXOR(F.shiftright(word, LAST))
        out = word if out is None else out.bitwiseXOR(word)
    return out


def uniform(key: Column, stream: Column | int = 0) -> Column:
    """In the open interval from 0 to 1."""
    return (bits(key, stream) + 0.5) / float(MODULUS)


def bits_sql(key: str, stream: str = "0") -> str:
    """bits() in DuckDB's SQL."""
    key, stream, words = f"CAST({key} AS BIGINT)", f"CAST({stream} AS BIGINT)", []
    for k_low, k_high, k_stream, offset in WORDS:
        word = f"((({key} & {_MASK}) * {k_low} & {_MASK}) + ((({key} >> 32) & {_MASK}) * {k_high} & {_MASK}) + (({stream} & {_MASK}) * {k_stream} + {offset} & {_MASK}) & {_MASK})"
        for shift, by in ROUNDS:
            word = f"(xor({word}, {word} >> {shift}) * {by} & {_MASK})"
        words.append(f"xor({word}, {word} >> {LAST})")
    return f"xor({words[0]}, {words[1]})"


def uniform_sql(key: str, stream: str = "0") -> str:
    return f"(({bits_sql(key, stream)} + 0.5) / 4294967296.0::DOUBLE)"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def uniform_int(u, a: int, b: int) -> Column:
    return F.lit(a) + F.floor(u * (b - a + 1))


def uniform_real(u, a: float, b: float) -> Column:
    return F.lit(a) + u * (b - a)


def bernoulli(u, p: float) -> Column:
    return u < p


def geometric(u, p: float) -> Column:
    """Failures before the first success."""
    return F.floor(F.log(1 - u) / math.log(1 - p))


def exponential(u, rate: float) -> Column:
    return -F.log(1 - u) / rate


def weibull(u, shape: float, scale: float) -> Column:
    return scale * F.pow(-F.log(1 - u), 1 / shape)


def extreme_value(u, a: float, b: float) -> Column:
    return a - b * F.log(-F.log(u))


def normal(u, v, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller from two uniforms."""
    return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def lognormal(u, v, m: float, s: float) -> Column:
    return F.exp(normal(u, v, m, s))


def cauchy(u, a: float, b: float) -> Column:
    return a + b * F.tan(F.pi() * (u - 0.5))


#: Sums of up to so many draws are written out, which compiles; longer ones are folds over an array.
WRITTEN_OUT = 16


def _fold(n: int, start, step) -> Column:
    """step over the numbers below n, from start: one expression, whatever n."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step) if n > 0 else start


def _sum(n: int, zero, term) -> Column:
    """The sum of term(k) for k below n."""
    if n > WRITTEN_OUT:
        return _fold(n, zero, lambda s, k: s + term(k))
    for k in range(n):
        zero = zero + term(k)
    return zero


def poisson(key: Column, mean: float) -> Column:
    """By the cumulative probabilities; large means as the sum of parts of at most 500.

    Probabilities are added up to 10 deviations and 40 beyond the mean: the
    generator's draws end 2^-33 below 1, far short of that.
    """
    parts = max(1, math.ceil(mean / 500))
    part = mean / parts
    most = math.ceil(part + 10 * math.sqrt(part) + 40)

    def one(u):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"), F.lit(math.exp(-part)).alias("p"))
        add = lambda s, k: F.struct((s["n"] + (u >= s["sum"] + s["p"]).cast("long")).alias("n"), (s["sum"] + s["p"]).alias("sum"), (s["p"] * F.lit(part) / (k + 1)).alias("p"))
        return _fold(most, start, add)["n"]

    return _sum(parts, F.lit(0).cast("long"), lambda k: let(uniform(key, k), one))


def binomial(key: Column, trials: int, p: float) -> Column:
    return _sum(trials, F.lit(0), lambda k: (uniform(key, k) < p).cast("int"))


def negative_binomial(key: Column, successes: int, p: float) -> Column:
    return _sum(successes, F.lit(0).cast("long"), lambda k: geometric(uniform(key, k), p).cast("long"))


def chi_squared(key: Column, n: int, stream: int = 0) -> Column:
    """From the streams ``stream`` to ``stream`` + 2 * n - 1."""
    return _sum(n, F.lit(0.0), lambda k: F.pow(normal(uniform(key, 2 * k + stream), uniform(key, 2 * k + stream + 1), 0.0, 1.0), 2))


#: Tries of gamma(); each fails with a probability under 0.05, all of them under 1e-80.
TRIES = 64


def gamma(key: Column, shape: float, scale: float) -> Column:
    """For any positive shape: the first accepted try of a cubed normal; shapes under 1 from the next one up."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def accepted(x, u):
        v = F.pow(1 + c * x, 3)
        ok = (v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(ok, d * v).otherwise(F.lit(-1.0))

    def attempt(done, k):
        x = normal(uniform(key, 3 * k), uniform(key, 3 * k + 1))
        return F.when(done >= 0, done).otherwise(let(F.struct(x.alias("x"), uniform(key, 3 * k + 2).alias("u")), lambda t: accepted(t["x"], t["u"])))

    found = _fold(TRIES, F.lit(-1.0), attempt)
    return (found if shape >= 1 else found * F.pow(uniform(key, 3 * TRIES), 1 / shape)) * scale


def student_t(key: Column, n: int) -> Column:
    return normal(uniform(key, 0), uniform(key, 1)) / F.sqrt(chi_squared(key, n, 2) / n)


def fisher_f(key: Column, m: int, n: int) -> Column:
    return (chi_squared(key, m) / m) / (chi_squared(key, n, 2 * m) / n)


class Distribution:
    """A distribution as an object that gives a Column for a key: any function of a key column, with its parameters.

    Distribution(uniform_int, 1, 6) takes the functions here that begin with u (or u
    and v); Distribution(gamma, 2.5, 1.0) those that begin with key; and any function
    of a key column of one's own works alike.
    """

    def __init__(self, function, *parameters):
        import inspect

        self.function, self.parameters = function, parameters
        self.inputs = [p for p in inspect.signature(function).parameters if p in ("u", "v")]

    def __call__(self, key: Column) -> Column:
        drawn = [uniform(key, k) for k in range(len(self.inputs))] or [key]
        return self.function(*drawn, *self.parameters)


def discrete(u, weights: list[float]) -> Column:
    """Index of the first cumulative weight above u times the total."""
    total, cum, out = sum(weights), 0.0, F.lit(0)
    for w in weights[:-1]:
        cum += w
        out = out + (u >= cum / total).cast("int")
    return out


def piecewise_constant(u, v, edges: list[float], weights: list[float]) -> Column:
    lo, width = F.lit(edges[:-1]), F.lit([b - a for a, b in zip(edges, edges[1:])])
    k = discrete(u, weights)
    return F.get(lo, k) + v * F.get(width, k)


def piecewise_linear(u, v, edges: list[float], densities: list[float]) -> Column:
    """A value whose density runs linearly between the edges: u picks the bin by its area, v the place in it."""
    bins = list(zip(edges, edges[1:], densities, densities[1:]))
    at = discrete(u, [(a + b) / 2 * (hi - lo) for lo, hi, a, b in bins])
    out = F.lit(None).cast("double")
    for k, (lo, hi, a, b) in enumerate(bins):
        t = v if a == b else (F.sqrt(a * a + v * (b * b - a * a)) - a) / (b - a)
        out = F.when(at == k, lo + t * (hi - lo)).otherwise(out)
    return out
