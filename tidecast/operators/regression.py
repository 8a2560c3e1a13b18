"""Ridge regressions of any width, one per group, fitted from sums.

What a fit needs of its rows are a count, the sums of each input and the sums of their
products: one row per group, combined before the shuffle and added up with those of days that
come later. The equations are solved on that row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An input whose variance, or what other inputs leave of it, is below this share of its
#: mean square says nothing and gets the coefficient zero.
NEGLIGIBLE = 1e-10


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def moments(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``n, sums, products`` per group of rows with ``x`` (array of ``width`` doubles) and ``y``.

    ``sums`` are those of the inputs and of y, ``products`` those of all pairs of them, the
    second index not above the first. Rows with a null or non-finite number are left out.
    """
    z = [F.get("x", F.lit(i)) for i in range(width)] + [F.col("y")]
    usable = rows.where(reduce(and_, map(_finite, z), F.size("x") == width))
    return usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(a) for a in z]).alias("sums"),
        F.array(*[F.sum(z[i] * z[j]) for i in range(width + 1) for j in range(i + 1)]).alias(
            "products"
        ),
    )


def added(known: DataFrame, new: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The moments of two sets of rows together, from the moments of each."""

    def total(name: str, length: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(length)]).alias(name)

    return known.unionByName(new).groupBy(*keys).agg(
        F.sum("n").alias("n"), total("sums", width + 1),
        total("products", (width + 1) * (width + 2) // 2),
    )


def fitted(sums: DataFrame, width: int, reg: float = 0.0) -> DataFrame:
    """Add ``b`` (a coefficient per input), ``mean_x`` and ``mean_y`` to a row of moments.

    Inputs and y are taken from their means, so the intercept is not penalised; the penalty
    is ``reg`` times the variance of each input. The symmetric system is eliminated input by
    input. A constant input, or without a penalty one that earlier inputs determine, gets zero
    and leaves the others' fit as it would be without it.
    """
    means = sums.select("*", F.transform("sums", lambda s: s / F.col("n")).alias("_mean"))

    def square(i: Column, j: Column) -> Column:
        hi, lo = F.greatest(i, j), F.least(i, j)
        return F.get("products", (hi * (hi + 1) / 2).cast("int") + lo) / F.col("n")

    def entry(i: Column, j: Column) -> Column:
        value = square(i, j) - F.get("_mean", i) * F.get("_mean", j)
        return F.when(i == j, value * (1 + reg)).otherwise(value)

    inputs = F.sequence(F.lit(0), F.lit(width - 1))
    system = means.select(
        "*",
        F.transform(inputs, lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(width)), lambda j: entry(i, j))).alias("_m"),
        F.transform(inputs, lambda i: square(i, i)).alias("_size"),
    )

    def without(m: Column, p: Column) -> Column:
        """The system with input ``p`` eliminated from all rows but its own."""
        row = F.get(m, p)
        pivot = F.get(row, p)
        usable = pivot > F.lit(NEGLIGIBLE) * F.get("_size", p)
        return F.transform(m, lambda r, i: (
            F.when(~usable, F.when(i == p, F.transform(r, lambda v: F.lit(0.0))).otherwise(r))
            .when(i == p, F.transform(r, lambda v: F.try_divide(v, pivot)))
            .otherwise(F.zip_with(r, row, lambda a, b: a - F.try_divide(F.get(r, p), pivot) * b))
        ))

    solved = F.aggregate(inputs, F.col("_m"), without)
    return system.select(
        *sums.columns,
        F.transform(solved, lambda r: F.get(r, F.lit(width))).alias("b"),
        F.slice("_mean", 1, width).alias("mean_x"),
        F.get("_mean", F.lit(width)).alias("mean_y"),
    )


def predicted(x: str, width: int) -> Column:
    """What a fit expects at column ``x``, on rows joined with ``fitted``."""
    total = F.col("mean_y")
    for i in range(width):
        b, v, mean = (F.get(c, F.lit(i)) for c in ("b", x, "mean_x"))
        total = total + b * (v - mean)
    return total
