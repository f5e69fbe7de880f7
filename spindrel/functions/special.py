"""Special functions as expressions of built-in ones, as Columns and as SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 7


def digamma_sql(x: str) -> str:
    """psi(x) for x > 0: seven steps of the recurrence, then the asymptotic series."""
    y = f"(({x}) + {SHIFT})"
    steps = " - ".join(f"1 / (({x}) + {i})" for i in range(SHIFT))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * power({y}, 2)) + 1 / (120 * power({y}, 4)) - 1 / (252 * power({y}, 6)) + 1 / (240 * power({y}, 8)) - {steps})"


def lgamma_sql(x: str) -> str:
    """ln gamma(x) for x > 0: seven steps of the recurrence, then Stirling's series."""
    y = f"(({x}) + {SHIFT})"
    steps = " - ".join(f"ln(({x}) + {i})" for i in range(SHIFT))
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * power({y}, 3)) + 1 / (1260 * power({y}, 5)) - 1 / (1680 * power({y}, 7)) - {steps})"


def digamma(x, log=F.log):
    """psi of a Column, or of an array with its own ``log``."""
    y = x + SHIFT
    out = log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for i in range(SHIFT):
        out = out - 1 / (x + i)
    return out


def lgamma(x: Column) -> Column:
    y = x + SHIFT
    out = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for i in range(SHIFT):
        out = out - F.log(x + i)
    return out


def pair_moment(a_i: str, a_j: str, same: str, total: str) -> str:
    """SQL of E[p_i p_j] of a Dirichlet: a_i (a_j + [i = j]) / (s (s + 1))."""
    return f"({a_i}) * (({a_j}) + CASE WHEN {same} THEN 1 ELSE 0 END) / (({total}) * (({total}) + 1))"
