"""Scalar functions on columns with IEEE results: no error for a division by
zero or a logarithm of zero, NaN unequal to itself, and Python's rounding of
quotients. Each also works element-wise on arrays through `each`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inf() -> Column:
    return F.lit(float("inf"))


def _not_a_number() -> Column:
    return F.lit(float("nan"))


def add(x: Column, y: Column) -> Column:
    return x + y


def sub(x: Column, y: Column) -> Column:
    return x - y


def multiply(x: Column, y: Column) -> Column:
    return x * y


def divide(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.when(y != 0, x / F.nullif(y, F.lit(0.0))).when((x == 0) | F.isnan(x), _not_a_number()).when(x > 0, _inf()).when(x < 0, -_inf())


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def int_power(x: Column, y: Column) -> Column:
    return F.pow(x, y).cast("long")


def minimum(x: Column, y: Column) -> Column:
    """The smaller, or x where they don't compare."""
    return F.when((y < x) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")), y).otherwise(x)


def maximum(x: Column, y: Column) -> Column:
    return F.when((x < y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")), y).otherwise(x)


def floordiv(x: Column, y: Column) -> Column:
    return F.floor(divide(x, y))


def mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return x - y * F.floor(divide(x, y))


def neg(x: Column) -> Column:
    return -(x.cast("double"))


def pos(x: Column) -> Column:
    return x.cast("double")


def _log(name: str) -> Callable[[Column], Column]:
    fn = getattr(F, name)

    def log(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.isnan(x) | (x < 0), _not_a_number()).when(x == 0, -_inf()).otherwise(fn(x))

    log.__name__ = name
    return log


ln, log2, log10 = _log("ln"), _log("log2"), _log("log10")
exp, sqrt, absolute = F.exp, F.sqrt, F.abs
sin, cos, tan, arcsin, arccos, arctan = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan
sinh, cosh, tanh, arcsinh, arccosh, arctanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


#: Terms of the series and of the continued fraction below.
_TERMS, _FRACTION = 40, 40


def erf(x: Column) -> Column:
    """The error function: its power series near zero, a continued fraction of
    the complement elsewhere; errors stay under 1e-14."""
    a = F.abs(x.cast("double"))
    term = F.transform(F.sequence(F.lit(1), F.lit(_TERMS)), lambda n: n)
    near = F.aggregate(term, F.struct(a.alias("t"), a.alias("s")), lambda acc, n: F.struct((acc["t"] * a * a * 2.0 / (2.0 * n + 1.0)).alias("t"), (acc["s"] + acc["t"] * a * a * 2.0 / (2.0 * n + 1.0)).alias("s")), lambda acc: acc["s"] * F.exp(-a * a) * 1.1283791670955126)
    below = F.aggregate(F.sequence(F.lit(_FRACTION), F.lit(1), F.lit(-1)), a, lambda acc, n: a + n / 2.0 / acc)
    far = 1.0 - F.exp(-a * a) * 0.5641895835477563 / below
    return F.when(F.isnan(a), _not_a_number()).otherwise(F.signum(x.cast("double")) * F.when(a < 2.5, near).when(a < 27, far).otherwise(1.0))


def eq(x: Column, y: Column) -> Column:
    return (x == y) & ~_nan(x) & ~_nan(y)


def ne(x: Column, y: Column) -> Column:
    return ~eq(x, y)


def _nan(x: Column) -> Column:
    return F.isnan(x.try_cast("double")) if hasattr(x, "try_cast") else F.isnan(x)


def _ordered(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: op(x, y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))


gt, lt = _ordered(lambda x, y: x > y), _ordered(lambda x, y: x < y)
ge, le = _ordered(lambda x, y: x >= y), _ordered(lambda x, y: x <= y)


def not_(x: Column) -> Column:
    return ~x


def bitwise_not(x: Column) -> Column:
    return F.bitwise_not(x)


def and_(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def or_(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def each(fn: Callable[..., Column], *arrays: Column) -> Column:
    """fn element by element over one or two arrays."""
    return F.transform(arrays[0], fn) if len(arrays) == 1 else F.zip_with(arrays[0], arrays[1], fn)
