"""Column expressions that Spark lacks, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of W. J. Cody's rational approximations of erf and erfc (Math. Comp. 23, 1969).
ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
ERFC_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
ERFC_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
INV_SQRT_PI = 5.6418958354775628695e-1


def _ratio(x: str, top_first: float, top: tuple, top_last: float, bottom: tuple, bottom_last: float) -> str:
    """((first*x + t0)*x + ...)*x + last over ((x + b0)*x + ...)*x + last, as SQL."""
    num, den = f"({top_first!r}D * {x})", x
    for t, b in zip(top, bottom, strict=True):
        num, den = f"(({num} + {t!r}D) * {x})", f"(({den} + {b!r}D) * {x})"
    return f"(({num} + {top_last!r}D) / ({den} + {bottom_last!r}D))"


def erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0 (clamped at 26, where it vanishes), as SQL of Spark; for DuckDB drop the D suffixes by `portable`."""
    x = f"least({x}, 26.0D)"
    y2 = f"({x} * {x})"
    small = f"(1.0D - {x} * {_ratio(y2, ERF_A[4], ERF_A[:3], ERF_A[3], ERF_B[:3], ERF_B[3])})"
    mid = f"(exp(-{y2}) * {_ratio(x, ERFC_C[8], ERFC_C[:7], ERFC_C[7], ERFC_D[:7], ERFC_D[7])})"
    inv = f"(1.0D / greatest({y2}, 1.0D))"
    tail = f"({inv} * {_ratio(inv, ERFC_P[5], ERFC_P[:4], ERFC_P[4], ERFC_Q[:4], ERFC_Q[4])})"
    large = f"(exp(-{y2}) / greatest({x}, 1.0D) * ({INV_SQRT_PI!r}D - {tail}))"
    return f"(CASE WHEN {x} <= 0.46875D THEN {small} WHEN {x} <= 4.0D THEN {mid} ELSE {large} END)"


def erfc(x: str) -> Column:
    """erfc of a column or SQL expression that is >= 0."""
    return F.expr(erfc_sql(f"({x})"))


def portable(sql: str) -> str:
    """Spark SQL of this module as DuckDB's: double literals without their suffix."""
    import re

    return re.sub(r"(\d(?:e-?\+?\d+)?)D\b", r"\1", sql)


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, `other` where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(other))
