"""Vector functions over array<double> columns, and long-form (key, d, v) helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = Column | str
EPS = 1e-8


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Col) -> Column:
    """Array of any numbers as array<double>."""
    return _c(x).cast("array<double>")


def dot(a: Col, b: Col) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(x: Col) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v * v))


def scale(x: Col, by: Column) -> Column:
    return F.transform(_c(x), lambda v: v * by)


def add(a: Col, b: Col) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def axpy(a: Col, b: Col, by: Column) -> Column:
    """a + by * b."""
    return F.zip_with(_c(a), _c(b), lambda p, q: p + by * q)


#: How a norm becomes the divisor.  unit: norms below 1e-12 divide by one; plus: eps is added; clamp: at least eps; safe: a zero row stays zero.
DIVISORS = {
    "unit": lambda n: F.when(n < 1e-12, 1.0).otherwise(n),
    "plus": lambda n: n + EPS,
    "clamp": lambda n: F.greatest(n, F.lit(EPS)),
    "safe": lambda n: F.when(n == 0, 1.0).otherwise(n),
}


def normalise(x: Col, mode: str = "unit") -> Column:
    """x over its norm, with one of the DIVISORS."""
    return F.get(F.transform(F.array(_c(x)), lambda a: F.get(F.transform(F.array(DIVISORS[mode](norm(a))), lambda n: F.transform(a, lambda v: v / n)), 0)), 0)


def normalise_masked(x: Col, mask: list[int], eps: float = EPS) -> Column:
    """Only the dimensions of the mask are scaled, by their own norm."""
    inside = F.array(*[F.lit(i) for i in mask])
    picked = F.filter(_c(x), lambda v, i: F.array_contains(inside, i))
    n = norm(picked) + eps
    return F.transform(_c(x), lambda v, i: F.when(F.array_contains(inside, i), v / n).otherwise(v))


def hardsign(x: Col) -> Column:
    """-1 for negative numbers, else 1."""
    return F.transform(_c(x), lambda v: F.when(v < 0, -1.0).otherwise(1.0))


def cosine(a: Col, b: Col, eps: float = EPS) -> Column:
    """Inner product over the norms, each at least eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def similarity(a: Col, b: Col, metric: str) -> Column:
    if metric not in ("dot", "cos"):
        raise ValueError(f"unknown metric {metric!r}")
    return dot(a, b) if metric == "dot" else cosine(a, b)


def long_form(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """One row per dimension: keys, d, v.  The outer generator adds no filter that would compute x anew."""
    return df.select(*keys, F.posexplode_outer(x).alias("d", "v")).where(F.col("d").isNotNull())


def assemble(df: DataFrame, keys: list[str], name: str = "x") -> DataFrame:
    """Rows (keys, d, v) back to one array per key, in order of d."""
    cells = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("_cells"))
    return cells.select(*keys, F.transform("_cells", lambda c: c["v"]).alias(name))


def vector_mean(df: DataFrame, keys: list[str], x: str, weight: str | None = None) -> DataFrame:
    """Mean array per key, weighted if asked for; zero where the weights sum to nothing.

    Sums per dimension combine before the shuffle, so it carries one row per key,
    dimension and task.
    """
    cells = df.select(*keys, *([weight] if weight else []), F.posexplode(x).alias("d", "v"))
    w = F.col(weight) if weight else F.lit(1.0)
    mean = F.coalesce(F.try_divide(F.sum(F.col("v") * w), F.sum(w)), F.lit(0.0))
    return assemble(cells.groupBy(*keys, "d").agg(mean.alias("v")), keys, x)


def vector_sum(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Sum array per key."""
    cells = long_form(df, keys, x)
    return assemble(cells.groupBy(*keys, "d").agg(F.sum("v").alias("v")), keys, x)


def argmax(score: Column, label: Column, digits: int | None = 9) -> Column:
    """Aggregate: the label of the best score, the smallest one on a tie.

    Scores are rounded first, so that engines that add in another order agree.
    """
    s = F.round(score, digits) if digits is not None else score
    return F.max_by(label, F.struct(s, -label))
