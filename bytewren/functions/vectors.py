"""Vector and probability expressions over ARRAY<DOUBLE>, all built-in: they stay inside the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps on either side of zero of the two integer forms, and elements in a group of the smaller one (fixed values).
Q8_STEPS, Q4_STEPS, Q4_GROUP = 127, 7, 64
#: Total of a cumulative frequency table.
CDF_TOTAL = 1 << 24


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once: what a lambda mentions from outside would be worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def weighted_sum(v: Column) -> Column:
    """A digest of a vector: every element times its place, from 1."""
    return total(F.transform(v, lambda x, i: x * (i + 1)))


# Probabilities


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), p))
    return F.log(q / (1 - q))


def squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit_bin(x: Column) -> Column:
    """0 to 3 with borders at -1, 0 and 1."""
    return F.when(x < -1, 0).when(x < 0, 1).when(x < 1, 2).otherwise(3)


def bit_cost(p: Column, floor: float = 1e-15) -> Column:
    return -F.log2(F.greatest(p, F.lit(floor)))


def softmax(v: Column) -> Column:
    e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(e, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def entropy_nats(p: Column) -> Column:
    """Of a probability vector; parts up to 1e-30 count nothing."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 1e-30, x * F.log(x)).otherwise(0.0))


def argmax(v: Column) -> Column:
    """Index of the largest element, the first one on ties, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmax_last(v: Column) -> Column:
    return (F.size(v) - F.array_position(F.reverse(v), F.array_max(v))).cast("int")


def bit_probabilities(p: Column, byte: Column) -> Column:
    """P(bit is 1) of the byte's eight bits, most significant first, given its bits before; one half where no mass is left.

    p has 256 elements. The bytes that share the first j bits are a slice.
    """

    def at(j: int) -> Column:
        width = 1 << (8 - j)
        start = F.floor(byte / width).cast("int") * width
        both = total(F.slice(p, start + 1, width))
        one = total(F.slice(p, start + 1 + width // 2, width // 2))
        return F.when(both > 1e-10, one / both).otherwise(F.lit(0.5))

    return F.array(*(at(j) for j in range(8)))


def cdf(p: Column) -> Column:
    """Cumulative frequencies with CDF_TOTAL at the end: each symbol at least 1, the rounding rest to the commonest (the last on ties)."""

    def table(p: Column) -> Column:
        room = F.lit(CDF_TOTAL).cast("long") - F.size(p)
        extra = let(total(p), lambda z: F.transform(p, lambda x: F.when(z > 0, F.floor(x / z * room)).otherwise(F.lit(0)).cast("long")))
        return let(extra, lambda e: let(F.struct((room - F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x)).alias("rest"), argmax_last(e).alias("most")), lambda k: running(F.transform(e, lambda x, i: x + 1 + F.when(i == k["most"], k["rest"]).otherwise(F.lit(0))))))

    return let(p, table)


def uniform_cdf(n: Column) -> Column:
    each = F.floor(F.lit(CDF_TOTAL) / n).cast("long")
    return F.transform(F.sequence(F.lit(0), n), lambda i: i * each)


def running(v: Column) -> Column:
    """0 and all prefix sums of an array of longs."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(v, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def cdf_symbol(table: Column, cum: Column) -> Column:
    """The symbol in whose range a cumulative frequency falls."""
    return F.size(F.filter(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda x: x <= cum))


# Normalisation and elementwise operations


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def centred(c: Column) -> Column:
        return let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda s: F.transform(c, lambda x: x / s))

    return let(v, lambda v: let(let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)), centred))


def in_groups(v: Column, groups: int, size: int, f) -> Column:
    return F.concat(*(f(F.slice(v, g * size + 1, size)) for g in range(groups)))


def group_norm(v: Column, groups: int, size: int, eps: float = 1e-5) -> Column:
    return in_groups(v, groups, size, lambda part: layer_norm(part, eps))


def normalize_heads(v: Column, heads: int, size: int) -> Column:
    def one(part: Column) -> Column:
        return let(norm(part), lambda n: F.transform(part, lambda x: F.when(n > 1e-12, x / n).otherwise(F.lit(0.0))))

    return in_groups(v, heads, size, one)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def add_scaled(a: Column, b: Column, scale: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * scale)


def blend(a: Column, b: Column, share: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - share) + y * share)


def each_tanh(v: Column) -> Column:
    return F.transform(v, F.tanh)


def each_sigmoid(v: Column) -> Column:
    return F.transform(v, squash)


def squared_relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)))


# Quantisation; round() is half away from zero


def scale_of(v: Column, steps: int) -> Column:
    return let(F.array_max(F.transform(v, F.abs)), lambda most: F.when(most > 0, most / steps).otherwise(F.lit(1.0)))


def q8(v: Column, scale: Column | None = None) -> Column:
    """Integers of a row in -127 to 127, to be multiplied by scale_of(v, Q8_STEPS)."""
    return let(scale_of(v, Q8_STEPS) if scale is None else scale, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / s).cast("int")))))


def q4(v: Column) -> Column:
    """Integers of a group in -8 to 7, to be multiplied by scale_of(v, Q4_STEPS)."""
    return let(scale_of(v, Q4_STEPS), lambda s: F.transform(v, lambda x: F.greatest(F.lit(-8), F.least(F.lit(7), F.round(x / s).cast("int")))))


def q4_pack(q: Column) -> Column:
    """Two integers in a byte, the first in the lower half, as an array of byte values."""
    return let(q, lambda q: F.transform(F.sequence(F.lit(0), F.floor(F.size(q) / 2).cast("int") - 1), lambda i: F.pmod(F.get(q, i * 2), F.lit(16)) + F.pmod(F.get(q, i * 2 + 1), F.lit(16)) * 16))


def q4_unpack(packed: Column) -> Column:
    signed = lambda x: F.when(x > 7, x - 16).otherwise(x)
    return F.flatten(F.transform(packed, lambda b: F.array(signed(b % 16), signed(F.floor(b / 16).cast("int")))))


def dequantize(q: Column, scale: Column) -> Column:
    return let(scale, lambda s: F.transform(q, lambda x: x * s))


def q_dot(q: Column, scale: Column, w: Column, w_scale: Column) -> Column:
    """Dot product of two quantised vectors: integers are summed as longs, then scaled once."""
    return F.aggregate(F.zip_with(q, w, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) * (scale * w_scale)
