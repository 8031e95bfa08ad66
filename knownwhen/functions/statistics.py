"""Normal distribution and counter-hash columns, as plain arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations (Abramowitz-Stegun 7.1.26; Acklam).
ERF_T = 0.3275911
ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
CENTRAL_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRAL_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
TAIL_BOUND = 0.02425
EULER_MASCHERONI = 0.5772156649015329

PRIME = 2147483647


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """Value of a polynomial given from its highest power down."""
    power = len(coefficients) - 1
    total = F.lit(0.0)
    for i, k in enumerate(coefficients):
        total = total + F.lit(k) * F.pow(x, F.lit(float(power - i)))
    return total


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_T * x)
    erf = 1 - polynomial(ERF, t) * t * F.exp(-x * x)
    return (1 + F.signum(z) * erf) / 2


def normal_quantile(p: Column) -> Column:
    def tail(q: Column) -> Column:
        s = F.sqrt(-2 * F.ln(q))
        return polynomial(TAIL_NUM, s) / (polynomial(TAIL_DEN, s) * s + 1)

    q = p - 0.5
    r = q * q
    central = polynomial(CENTRAL_NUM, r) * q / (polynomial(CENTRAL_DEN, r) * r + 1)
    return F.when(p > 1 - TAIL_BOUND, -tail(1 - p)).when(p < TAIL_BOUND, tail(p)).otherwise(central)


def mix(x):
    """Two rounds of a power permutation modulo a prime; works on integers and integer arrays."""
    for add in (104729, 611953):
        x = (x + add) % PRIME
        sq = x * x % PRIME
        x = sq * sq % PRIME * x % PRIME
    return x
