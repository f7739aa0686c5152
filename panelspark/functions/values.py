"""Column helpers for one kind of missing value: NULL.  None of them depends on the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value if it is finite, else NULL (NaN is greater than infinity to Spark)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def number(x: Column) -> Column:
    """Any numeric or text column as a finite double."""
    return finite(x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


#: Acklam's rational approximation of the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def inverse_normal(p: Column, eps: float = 1e-6) -> Column:
    """Quantile of the normal distribution, to about 1e-9 relative."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))

    def poly(c: tuple, x: Column) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    tail = lambda q: poly(C, q) / (poly(D, q) * q + 1)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    middle = poly(A, q * q) * q / (poly(B, q * q) * (q * q) + 1)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)
