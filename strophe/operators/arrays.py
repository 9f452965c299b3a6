"""Elementwise and positional arithmetic on arrays of doubles; no shuffle, null in gives null out."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def layer_norm(x: Column, epsilon: float = 1e-5, gain: float = 1.0, bias: float = 0.0) -> Column:
    """Zero mean and unit population variance."""
    centred = let(mean(x), lambda m: F.transform(x, lambda e: e - m))

    def scaled(y: Column) -> Column:
        deviation = F.sqrt(total(F.transform(y, lambda e: e * e)) / F.size(y) + epsilon)
        return let(deviation, lambda d: F.transform(y, lambda e: e / d * gain + bias))

    return let(centred, scaled)


def unit_norm(x: Column, epsilon: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(total(F.transform(x, lambda e: e * e))), F.lit(epsilon))
    return let(norm, lambda n: F.transform(x, lambda e: e / n))


def noised(x: Column, noise: Column, t: Column) -> tuple[Column, Column, Column]:
    """Cosine schedule at t: a * x + s * noise, and the targets a * noise - s * x (velocity) and noise - x (flow)."""
    a, s = F.cos(t * math.pi / 2), F.sin(t * math.pi / 2)
    return F.zip_with(x, noise, lambda e, n: a * e + s * n), F.zip_with(x, noise, lambda e, n: a * n - s * e), F.zip_with(x, noise, lambda e, n: n - e)


def schedule_time(alpha: Column, sigma: Column) -> Column:
    return F.atan2(sigma, alpha) / math.pi * 2


def snake(x: Column, alpha: float, beta: float) -> Column:
    """x + sin²(alpha x) / (beta + 1e-9)."""
    return F.transform(x, lambda e: e + F.pow(F.sin(e * alpha), F.lit(2.0)) / (beta + 1e-9))


def rotate_half(x: Column) -> Column:
    """(-second half, first half)."""
    h = (F.size(x) / 2).cast("int")
    return F.concat(F.transform(F.slice(x, h + 1, h), lambda e: -e), F.slice(x, F.lit(1), h))


def rotary(x: Column, position: Column, dim: int, base: float = 10000.0) -> Column:
    """The first dim elements rotated by position times each pair's frequency; others stay."""
    half = dim // 2
    head = F.slice(x, 1, dim)
    angle = lambda i: position * F.pow(F.lit(base), -(F.pmod(i, F.lit(half)) * 2.0 / dim))
    out = let(rotate_half(head), lambda turned: F.transform(head, lambda e, i: e * F.cos(angle(i)) + F.get(turned, i) * F.sin(angle(i))))
    return F.concat(out, F.slice(x, dim + 1, F.greatest(F.size(x) - dim, F.lit(0))))


def sinusoid(position: Column, dim: int, period: float = 10000.0) -> Column:
    """Cosines, then sines, of position over period ** (i / (half - 1))."""
    half = dim // 2
    at = F.sequence(F.lit(0), F.lit(half - 1))
    phase = lambda i: position / F.pow(F.lit(period), i / float(half - 1))
    return F.concat(F.transform(at, lambda i: F.cos(phase(i))), F.transform(at, lambda i: F.sin(phase(i))))


def scaled_sinusoid(position: Column, dim: int, scale: float, theta: float = 10000.0) -> Column:
    """Sines, then cosines, of position times theta ** (-i / half), scaled."""
    half = dim // 2
    at = F.sequence(F.lit(0), F.lit(half - 1))
    phase = lambda i: position * F.pow(F.lit(theta), -i / float(half))
    return F.concat(F.transform(at, lambda i: F.sin(phase(i)) * scale), F.transform(at, lambda i: F.cos(phase(i)) * scale))


def fourier(x: Column, weights: list[float]) -> Column:
    """Cosines, then sines, of 2 pi x w."""
    w = F.array(*map(F.lit, weights))
    return F.concat(F.transform(w, lambda k: F.cos(2 * math.pi * x * k)), F.transform(w, lambda k: F.sin(2 * math.pi * x * k)))


def shrinking_mask(x: Column, step: int, steps: int) -> Column:
    """Which elements are at most (step + 1) / steps, as 0 and 1."""
    return F.transform(x, lambda e: (e <= (step + 1) / steps).cast("int"))


def euler(x: Column, steps: int, sigma: float, field) -> Column:
    """x carried from time sigma to 0 along field(x, t) in equal steps."""
    times = [sigma * (1 - i / steps) for i in range(steps + 1)]

    def step(x: Column, a: float, b: float) -> Column:
        return F.transform(x, lambda e: e + (b - a) * field(e, a))

    for a, b in zip(times, times[1:]):
        x = step(x, a, b)
    return x


def gaussian(x: Column) -> tuple[Column, Column]:
    """Mean, and softplus deviation + 1e-4, of an array whose halves are mean and scale."""
    h = (F.size(x) / 2).cast("int")
    return F.slice(x, F.lit(1), h), F.transform(F.slice(x, h + 1, h), lambda s: F.log1p(F.exp(s)) + 1e-4)


def kl(mean_: Column, deviation: Column) -> Column:
    """Sum over channels of mean² + var - ln var - 1."""
    return total(F.zip_with(mean_, deviation, lambda m, d: m * m + d * d - F.log(d * d) - 1))


def distance2(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def resampled_length(n: Column, rate: Column, wanted: Column) -> Column:
    """Length at another rate, half to even."""
    return F.rint(n * wanted / rate).cast("bigint")


def euler_tempered(noise: Column, steps: int, temperature: float, field, sigma: float = 1.0) -> Column:
    """As euler, but from zeros if the temperature is below sigma; where time crosses the temperature the state jumps to its estimate blended with the noise."""
    times = [sigma * (1 - i / steps) for i in range(steps + 1)]
    x = noise if temperature >= sigma else F.transform(noise, lambda _: F.lit(0.0))

    def step(x: Column, a: float, b: float) -> Column:
        if a > temperature >= b:
            return F.zip_with(x, noise, lambda e, n: (1 - b) * (e - field(e, a)) + b * n)
        return F.transform(x, lambda e: e + (b - a) * field(e, a))

    for a, b in zip(times, times[1:]):
        x = step(x, a, b)
    return x


def velocity_sampler(x: Column, steps: int, model) -> Column:
    """A sampler for velocity models without noise: at each time the estimates of signal and noise, recombined for the next time."""
    times = [1 - i / steps for i in range(steps)]
    scale = lambda t: (math.cos(t * math.pi / 2), math.sin(t * math.pi / 2))

    def step(x: Column, t: float, after: float | None) -> Column:
        (a, s), nxt = scale(t), scale(after) if after is not None else (1.0, 0.0)

        def one(e: Column) -> Column:
            v = model(e, t)
            return (e * a - v * s) * nxt[0] + (e * s + v * a) * nxt[1]

        return F.transform(x, one)

    for t, after in zip(times, [*times[1:], None]):
        x = step(x, t, after)
    return x


def variation(x: Column, noise: Column, strength: float) -> Column:
    """A blend of given data and noise by a strength of at most 1."""
    s = min(strength, 1.0)
    return F.zip_with(x, noise, lambda e, n: e * (1 - s) + n * s)


def rotary_2d(position: Column, width: int, dim: int, base: float = 10000.0) -> Column:
    """Angles of a position in a grid of rows of the given width: by row, then by column, each over half of dim and repeated."""
    half = dim // 2
    n = half // 2
    row, column = F.floor(position / F.lit(width)), F.pmod(position, F.lit(width))
    at = F.sequence(F.lit(0), F.lit(half - 1))
    angles = lambda p: F.transform(at, lambda i: p * F.pow(F.lit(base), -(F.pmod(i, F.lit(n)) * 2.0 / half)))
    return F.concat(angles(row), angles(column))


def gated(x: Column) -> Column:
    """First half times the sigmoid-weighted second half."""
    h = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), h), F.slice(x, h + 1, h), lambda a, g: a * g / (1 + F.exp(-g)))


def clipped(x: Column) -> Column:
    """Soft clipping: the hyperbolic tangent."""
    return F.transform(x, F.tanh)


def table_row(table: Column, position: Column, scale: float) -> Column:
    """A row of an embedding table, scaled; a position beyond it is an error."""
    row = F.get(table, position)
    return F.transform(F.coalesce(row, F.raise_error(F.lit("a position beyond the table")).cast("array<double>")), lambda e: e * scale)


def masked(x: Column, mask: Column) -> Column:
    """x with zeros where the mask is 0."""
    return F.zip_with(x, mask, lambda e, m: e * m)


def mean_kernel(xs: Column, ys: Column) -> Column:
    """The mean over all pairs of vectors of exp(-mean squared difference / dimension)."""
    dim = F.size(F.get(xs, 0))
    row = lambda x: total(F.transform(ys, lambda y: F.exp(-distance2(x, y) / dim / dim)))
    return total(F.transform(xs, row)) / (F.size(xs) * F.size(ys))


def discrepancy(xs: Column, ys: Column) -> Column:
    """Maximum mean discrepancy of two samples of vectors (arrays of bounded size), by mean_kernel."""
    return mean_kernel(xs, xs) + mean_kernel(ys, ys) - 2 * mean_kernel(xs, ys)


def rotary_angles(position: Column, dim: int, base: float = 10000.0, interpolation: float = 1.0, rescale: float = 1.0) -> Column:
    """The angles of rotary for a position, each frequency twice; interpolation (at least 1) squeezes positions, rescale stretches the base."""
    if interpolation < 1:
        raise ValueError(f"interpolation {interpolation} is below 1")
    half, b = dim // 2, base * rescale ** (dim / (dim - 2))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: position / interpolation * F.pow(F.lit(b), -(F.pmod(i, F.lit(half)) * 2.0 / dim)))


def rotary_scale(position: Column, length: Column, dim: int, scale_base: float = 512.0) -> Column:
    """The scales by which rotary with decay multiplies queries (and divides keys) at a position of a sequence; 1 at its middle."""
    half = dim // 2
    power = (position - F.floor(length / F.lit(2))) / scale_base
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pow((F.pmod(i, F.lit(half)) * 2 + 0.4 * dim) / (1.4 * dim), power))


def low_discrepancy(i: Column) -> Column:
    """The i-th number of a sequence that fills [0, 1) evenly: the bits of i behind the point, in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), 32, "0")), 2, 10).cast("double") / 2**32


def logit_normal(z: Column) -> Column:
    """A standard normal number as a time in (0, 1)."""
    return 1 / (1 + F.exp(-z))


def embedded(tables: list[Column], ids: list[Column], how: str = "sum") -> Column:
    """Rows of embedding tables (arrays of arrays) by their ids, added up or one behind the other; an id beyond its table is an error."""
    rows = [F.coalesce(F.get(t, i), F.raise_error(F.lit("an id beyond the table")).cast("array<double>")) for t, i in zip(tables, ids)]
    if how == "concat":
        return F.concat(*rows)
    if how != "sum":
        raise ValueError(f"unknown way to embed: {how}")
    out = rows[0]
    for r in rows[1:]:
        out = F.zip_with(out, r, lambda a, b: a + b)
    return out
