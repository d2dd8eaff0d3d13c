"""Vectors in array columns: norms, scaling, derivatives, element-wise statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LARGEST = 1.7976931348623157e308


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def norm(v: Column, p: int = 1) -> Column:
    if p == 1:
        return total(F.transform(v, lambda x: F.abs(x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def normalised(v: Column, p: int = 1) -> Column:
    """Vector over its Lp norm; a zero vector stays zero, what isn't finite is repaired."""
    return F.transform(F.array(norm(v, p)), lambda n: F.transform(v, lambda x: repaired(F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(x, n)))))[0]


def repaired(x: Column) -> Column:
    """NaN becomes 0, infinities the largest numbers."""
    return F.when(F.isnan(x), 0.0).when(x > _LARGEST, _LARGEST).when(x < -_LARGEST, -_LARGEST).otherwise(x)


def variance(v: Column, ddof: int = 0) -> Column:
    squares = F.transform(F.array(mean(v)), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))))[0]
    return squares / (F.size(v) - ddof)


def standard_normal_variate(v: Column) -> Column:
    """(x - mean) / sample deviation of each vector."""
    parts = F.array(F.struct(mean(v).alias("m"), F.sqrt(variance(v, 1)).alias("s")))
    return F.transform(parts, lambda p: F.transform(v, lambda x: F.try_divide(x - p["m"], p["s"])))[0]


def standardised(v: Column, m: Column, s: Column) -> Column:
    """Element-wise (x - m) / s with vectors m and s."""
    return F.zip_with(F.zip_with(v, m, lambda x, y: x - y), s, lambda x, y: F.try_divide(x, y))


def gradient(v: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(v)
    return F.transform(
        v,
        lambda x, i: F.when(n < 2, F.lit(None).cast("double"))
        .when(i == 0, F.get(v, F.lit(1)) - x)
        .when(i == n - 1, x - F.get(v, n - 2))
        .otherwise((F.get(v, i + 1) - F.get(v, i - 1)) / 2),
    )


def stretched(v: Column, length: int) -> Column:
    """Vector stretched to a length by linear interpolation over its ends."""
    n = F.size(v)
    at = lambda i: i.cast("double") * (n - 1) / max(1, length - 1)
    low = lambda i: F.floor(at(i)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(v, low(i)) + (at(i) - low(i)) * (F.coalesce(F.get(v, low(i) + 1), F.get(v, low(i))) - F.get(v, low(i))))


def padded(v: Column, length: int, value: float = 0.0) -> Column:
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def affine(v: Column, matrix: list[list[float]], offset: list[float]) -> Column:
    """x M + b for a fixed matrix."""
    columns = list(zip(*matrix, strict=True))
    return F.array(*[total(F.zip_with(v, F.array(*map(F.lit, map(float, c))), lambda x, y: x * y)) + F.lit(float(b)) for c, b in zip(columns, offset, strict=True)])


def split_scaled(v: Column) -> Column:
    """Positive values over the largest, negative values over the magnitude of the smallest."""
    ends = F.array(F.struct(F.array_max(v).alias("hi"), F.array_min(v).alias("lo")))
    return F.transform(ends, lambda e: F.transform(v, lambda x: F.when(x > 0, x / e["hi"]).when(x < 0, -x / e["lo"]).otherwise(0.0)))[0]


def one_hot(index: Column, n: int, smoothing: float = 0.0) -> Column:
    on, off = 1 - smoothing, smoothing / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, F.lit(on)).otherwise(F.lit(off)))


def softmax(v: Column) -> Column:
    e = F.transform(F.array(F.array_max(v)), lambda m: F.transform(v, lambda x: F.exp(x - m)))[0]
    return F.transform(F.array(e), lambda w: F.transform(w, lambda x: x / total(w)))[0]


def argmax(v: Column) -> Column:
    """Place of the largest value, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def single_label(p: Column, threshold: float = 0.5, unsure: int = -1) -> Column:
    """The one class above the threshold, else ``unsure``."""
    above = F.filter(F.transform(p, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())
    return F.when(F.size(above) == 1, above[0]).otherwise(F.lit(unsure))


def absorption(v: Column) -> Column:
    return F.transform(v, lambda x: -F.ln(x))


def elementwise(df: DataFrame, keys: list[str], column: str, how: str = "mean", skip_nan: bool = False) -> DataFrame:
    """One vector a group: the mean, median, sample or population deviation of each place.

    ``skip_nan`` leaves out vectors that hold NaN.  A deviation over one vector is 0.
    Values are added up by place before the shuffle; only the median moves them all.
    """
    v = doubles(column)
    rows = df.where(~F.exists(v, F.isnan)) if skip_nan else df
    long = rows.select(*keys, F.posexplode(v).alias("_at", "_x"))
    one = {
        "mean": F.avg("_x"),
        "median": F.median("_x"),
        "sum": F.sum("_x"),
        "std": F.when(F.count("_x") == 1, 0.0).otherwise(F.stddev_samp("_x")),
        "std_pop": F.stddev_pop("_x"),
    }[how]
    each = long.groupBy(*keys, "_at").agg(one.alias("_y"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_y"))), lambda s: s["_y"])
    return each.groupBy(*keys).agg(ordered.alias(column))
