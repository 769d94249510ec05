"""Column expressions over numeric vectors (arrays). All stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = int | float


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def at(x: Column, i: Column | int) -> Column:
    """Element ``i`` counted from 0; null beyond the end."""
    return F.get(x, i if isinstance(i, Column) else F.lit(i))


def each(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(value, position from 0)`` of each element."""
    return F.transform(x, f)


def zscore(x: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    return each(x, lambda v, i: (v - at(mean, i)) / (at(std, i) + eps))


def unzscore(x: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    """Inverse; dimensions beyond the statistics have mean 0 and deviation 1."""
    return each(x, lambda v, i: v * (F.coalesce(at(std, i), F.lit(1.0)) + eps) + F.coalesce(at(mean, i), F.lit(0.0)))


def quantile_norm(x: Column, lo: Column, hi: Column, eps: float = 1e-6) -> Column:
    """[lo, hi] to [-1, 1] without clipping."""
    return each(x, lambda v, i: (v - at(lo, i)) / (at(hi, i) - at(lo, i) + eps) * 2 - 1)


def unquantile_norm(x: Column, lo: Column, hi: Column, eps: float = 1e-6) -> Column:
    """Inverse; dimensions beyond the statistics pass through."""
    return each(x, lambda v, i: F.when(at(lo, i).isNull(), v).otherwise((v + 1) / 2 * (at(hi, i) - at(lo, i) + eps) + at(lo, i)))


def clipped(v: Column, lo: Number, hi: Number) -> Column:
    return F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo)))


def bounded(x: Column, lo: Column, hi: Column, mask: Column | None = None, eps: float = 1e-8) -> Column:
    """[lo, hi] to [-1, 1], clipped; equal bounds give 0; unmasked dimensions pass through."""

    def one(v, i):
        y = F.when(at(lo, i) == at(hi, i), 0.0).otherwise(clipped(2 * (v - at(lo, i)) / (at(hi, i) - at(lo, i) + eps) - 1, -1, 1))
        return y if mask is None else F.when(at(mask, i), y).otherwise(v)

    return each(x, one)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """[lo, hi] to [-1, 1]; equal bounds give 0."""
    return each(x, lambda v, i: F.when(at(lo, i) == at(hi, i), 0.0).otherwise(2 * (v - at(lo, i)) / (at(hi, i) - at(lo, i)) - 1))


def unminmax(x: Column, lo: Column, hi: Column) -> Column:
    """Inverse of ``minmax``; values are clipped to [-1, 1] first."""
    return each(x, lambda v, i: (clipped(v, -1, 1) + 1) / 2 * (at(hi, i) - at(lo, i)) + at(lo, i))


def unit_range(x: Column, lo: Column, hi: Column, eps: float = 1e-8) -> Column:
    """[lo, hi] to [0, 1] with ``eps`` in the denominator."""
    return each(x, lambda v, i: (v - at(lo, i)) / (at(hi, i) - at(lo, i) + eps))


def midpoint_range(x: Column, lo: Column, hi: Column, eps: float) -> Column:
    """[lo, hi] to [-1, 1]; dimensions narrower than ``eps`` only lose their midpoint."""
    width = lambda i: at(hi, i) - at(lo, i)
    mid = lambda i: (at(hi, i) + at(lo, i)) / 2
    return each(x, lambda v, i: F.when(width(i) < eps, v - mid(i)).otherwise((v - mid(i)) * 2 / width(i)))


def minus_where(a: Column, s: Column, mask: Column) -> Column:
    """``a - s`` on masked leading dimensions."""
    return each(a, lambda v, i: v - F.when(F.coalesce(at(mask, i), F.lit(False)), at(s, i)).otherwise(0.0))


def plus_where(a: Column, s: Column, mask: Column) -> Column:
    return each(a, lambda v, i: v + F.when(F.coalesce(at(mask, i), F.lit(False)), at(s, i)).otherwise(0.0))


def wrap_once(v: Column, limit: float) -> Column:
    """Into [-limit, limit] by one turn of twice the limit at most."""
    return F.when(v > limit, v - 2 * limit).when(v < -limit, v + 2 * limit).otherwise(v)


def wrap_angle(v: Column) -> Column:
    return F.atan2(F.sin(v), F.cos(v))


def bool_mask(*runs: int) -> Column:
    """bool_mask(2, -3): two true, then three false."""
    return F.array(*[F.lit(n > 0) for n in runs for _ in range(abs(n))])


def binarise(x: Column, thresholds: Sequence[float | None]) -> Column:
    """1 strictly above the dimension's threshold, else 0; dimensions without one pass through."""
    limits = F.array(*[F.lit(t).cast("double") for t in thresholds])
    return each(x, lambda v, i: F.when(at(limits, i).isNull(), v).otherwise(F.when(v > at(limits, i), 1.0).otherwise(0.0)))


def squash(x: Column, bound: Column, scale: float = 1.5) -> Column:
    return each(x, lambda v, i: F.asinh(v / (scale * at(bound, i))))


def unsquash(x: Column, bound: Column, scale: float = 1.5) -> Column:
    return each(x, lambda v, i: F.sinh(v) * scale * at(bound, i))


def linear_tails(x: Column, lo: Column, hi: Column) -> Column:
    """Identity inside [lo, hi], logarithmic tails outside."""
    return each(
        x,
        lambda v, i: F.when(v > at(hi, i), at(hi, i) + F.log1p(F.greatest(v - at(hi, i), F.lit(0.0)))).when(v < at(lo, i), at(lo, i) - F.log1p(F.greatest(at(lo, i) - v, F.lit(0.0)))).otherwise(v),
    )


def unlinear_tails(x: Column, lo: Column, hi: Column) -> Column:
    return each(x, lambda v, i: F.when(v > at(hi, i), at(hi, i) + F.expm1(v - at(hi, i))).when(v < at(lo, i), at(lo, i) - F.expm1(at(lo, i) - v)).otherwise(v))


def sin_cos(x: Column) -> Column:
    """All sines, then all cosines."""
    return F.concat(F.transform(x, F.sin), F.transform(x, F.cos))


def action_tokens(x: Column, bins: int = 256, lo: float = -1.0, hi: float = 1.0, vocabulary: int = 32000) -> Column:
    """Token of each value: clipped, put in one of ``bins`` - 1 equal bins (edges by ``bins`` points), counted down from
    the end of the vocabulary."""
    width = (hi - lo) / (bins - 1)
    return each(x, lambda v, i: (F.lit(vocabulary) - F.least(F.floor((clipped(v, lo, hi) - lo) / width) + 1, F.lit(bins))).cast("int"))


def action_values(tokens: Column, bins: int = 256, lo: float = -1.0, hi: float = 1.0, vocabulary: int = 32000) -> Column:
    """Bin centres of tokens; bins are clipped to 0 .. ``bins`` - 2."""
    width = (hi - lo) / (bins - 1)
    return each(tokens, lambda t, i: F.lit(lo) + (F.greatest(F.least(F.lit(vocabulary) - t - 1, F.lit(bins - 2)), F.lit(0)) + 0.5) * width)


def padded(x: Column, n: int, value: float = 0.0) -> Column:
    """Filled up to ``n``; a longer vector stays as it is."""
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def fixed(x: Column, n: int) -> Column:
    """Filled with zeros or cut to exactly ``n``."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def pad_mask(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(x))


def is_prefix_mask(mask: Column) -> Column:
    """True values first, then false ones only."""
    return ~F.exists(F.sequence(F.lit(1), F.greatest(F.size(mask) - 1, F.lit(1))), lambda i: F.coalesce(at(mask, i), F.lit(False)) & ~F.coalesce(at(mask, i - 1), F.lit(True)))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def has_outlier(x: Column, limit: float) -> Column:
    return F.exists(x, lambda v: F.abs(v) > limit)


def every(x: Column, step: int) -> Column:
    """x[::step]"""
    return F.filter(x, lambda v, i: i % step == 0)


def chunks(x: Column, size: int) -> Column:
    """Consecutive pieces; the last may be short; no pieces of an empty array."""
    return F.when(F.size(x) == 0, F.array().cast("array<array<double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(x, i + 1, F.lit(size)))
    )


def resampled(x: Column, n: int) -> Column:
    """Linear resample to ``n`` points from end to end."""
    last = F.size(x) - 1

    def point(k):
        t = k * last / float(max(n - 1, 1))
        a = F.floor(t).cast("int")
        b = F.least(a + 1, last)
        return at(x, a) + (at(x, b) - at(x, a)) * (t - a)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def euler_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> Column:
    """(w, x, y, z) of intrinsic z-y-x angles."""
    c, s = (lambda a: F.cos(a / 2)), (lambda a: F.sin(a / 2))
    return F.array(
        c(roll) * c(pitch) * c(yaw) + s(roll) * s(pitch) * s(yaw),
        s(roll) * c(pitch) * c(yaw) - c(roll) * s(pitch) * s(yaw),
        c(roll) * s(pitch) * c(yaw) + s(roll) * c(pitch) * s(yaw),
        c(roll) * c(pitch) * s(yaw) - s(roll) * s(pitch) * c(yaw),
    )


def quaternion_to_matrix(q: Column) -> Column:
    """Row-major 3 x 3 matrix of a unit (w, x, y, z)."""
    w, x, y, z = (at(q, i) for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def matrix_to_six(m: Column) -> Column:
    """The first two rows of a row-major matrix."""
    return F.slice(m, 1, 6)


def six_to_matrix(d: Column) -> Column:
    """Rotation matrix from two (not necessarily orthonormal) rows by Gram-Schmidt."""
    a, b = F.slice(d, 1, 3), F.slice(d, 4, 3)
    e1 = F.transform(a, lambda v: v / norm(a))
    rest = F.zip_with(b, e1, lambda v, e: v - dot(e1, b) * e)
    e2 = F.transform(rest, lambda v: v / norm(rest))
    return F.concat(e1, e2, cross(e1, e2))


def cross(a: Column, b: Column) -> Column:
    (a0, a1, a2), (b0, b1, b2) = ([at(v, i) for i in range(3)] for v in (a, b))
    return F.array(a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0)


def matmul3(a: Column, b: Column) -> Column:
    """Product of row-major 3 x 3 matrices."""
    return F.array(*[sum((at(a, 3 * r + k) * at(b, 3 * k + c) for k in range(1, 3)), at(a, 3 * r) * at(b, c)) for r in range(3) for c in range(3)])


def transpose3(m: Column) -> Column:
    return F.array(*[at(m, 3 * r + c) for c in range(3) for r in range(3)])


def axis_angle(q: Column) -> Column:
    """Axis times angle of a unit (w, x, y, z)."""
    v = F.slice(q, 2, 3)
    n = norm(v)
    angle = 2 * F.atan2(n, at(q, 0))
    return F.transform(v, lambda c: F.when(n < 1e-12, 2 * c).otherwise(c / n * angle))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Spherical interpolation of unit quaternions along the shorter arc; nearly equal ones by a normalised line."""
    raw = dot(a, b)
    cosine = F.least(F.abs(raw), F.lit(1.0))
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    angle = F.acos(cosine)
    near = cosine > 0.9995
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    mixed = F.zip_with(a, b, lambda x, y: x * wa + y * wb)
    return F.transform(mixed, lambda v: v / norm(mixed))


PI = math.pi
