"""Column expressions and scalar helpers of the panel operators."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return math.nan if math.isnan(x) else _NORMAL.cdf(x)


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


# Hart's rational approximation of the normal distribution function, double precision, highest power first.
_CDF_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the normal quantile, in the middle and in the tails.
_PPF_MID_OVER = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_PPF_MID_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_PPF_TAIL_OVER = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_PPF_TAIL_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_PPF_TAIL = 0.02425


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _tail(y: Column) -> Column:
    """The normal probability beyond y, from 0."""
    density = F.exp(-y * y / 2)
    # a continued fraction, far out
    depth = y + 0.65
    for k in range(12, 0, -1):
        depth = y + k / depth
    near = density * _polynomial(y, _CDF_OVER) / _polynomial(y, _CDF_UNDER)
    return F.when(y > 37, 0.0).when(y < 7.07106781186547, near).otherwise(density / depth / math.sqrt(2 * math.pi))


def normal_cdf_of(x: Column) -> Column:
    """The normal distribution function, to about 1e-14; null and NaN stay as they are."""
    value = _let(x, lambda v: F.when(v > 0, 1 - _let(F.abs(v), _tail)).otherwise(_let(F.abs(v), _tail)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(value)


def normal_ppf_of(p: Column) -> Column:
    """The normal quantile of probabilities from 0 to 1 (infinite at the ends), else null: a rational approximation and one step of Halley's method."""

    def first(low: Column) -> Column:
        middle = _let(low - 0.5, lambda q: _let(q * q, lambda s: q * _polynomial(s, _PPF_MID_OVER) / _polynomial(s, _PPF_MID_UNDER)))
        outer = _let(F.sqrt(-2 * F.log(low)), lambda root: _polynomial(root, _PPF_TAIL_OVER) / _polynomial(root, _PPF_TAIL_UNDER))
        return F.when(low < _PPF_TAIL, outer).otherwise(middle)

    def better(x: Column, low: Column) -> Column:
        return _let((_let(-x, _tail) - low) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda error: x - error / (1 + x * error / 2))

    low = lambda p: _let(F.least(p, 1 - p), lambda q: _let(first(q), lambda x: better(x, q)))
    value = _let(p, lambda v: F.when(v > 0.5, -low(v)).otherwise(low(v)))
    return F.when(p == 0, -math.inf).when(p == 1, math.inf).when((p > 0) & (p < 1), value)


def not_nan(c: Column) -> Column:
    """NaN and infinities are gaps: null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def simple_return(px: Column, before: Column) -> Column:
    """px / before - 1; null where either is a gap or before is 0."""
    return F.try_divide(px, before) - 1


def cost_rate(bps: float) -> float:
    """Basis points per side as a fraction."""
    if bps < 0:
        raise ValueError(f"bps must not be negative: {bps}")
    return bps * 1e-4


def linear_cost(delta: Column, bps: float | Column) -> Column:
    rate = bps * 1e-4 if isinstance(bps, Column) else F.lit(cost_rate(bps))
    return rate * F.abs(delta)


def impact_cost(delta: Column, sigma: Column, adv: Column, c: float) -> Column:
    """c * |sigma| * sqrt(|delta| / adv); 0 without a positive adv or with c = 0."""
    if c < 0:
        raise ValueError(f"c must not be negative: {c}")
    if c == 0:
        return F.lit(0.0)
    return F.when((adv > 0) & ~F.isnan(adv), c * F.abs(sigma) * F.sqrt(F.abs(delta) / adv)).otherwise(0.0)


def truncate(x: Column) -> Column:
    """Toward zero."""
    return x.cast("bigint").cast("double")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def period_key(d: Column, cadence: str) -> Column:
    """YYYY-MM-DD, ISO year and week (YYYY-Www), or YYYY-MM."""
    if cadence == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if cadence == "weekly":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
    if cadence == "monthly":
        return F.date_format(d, "yyyy-MM")
    raise ValueError(f"cadence must be daily, weekly or monthly: {cadence!r}")


def period_key_of(text: str, cadence: str) -> str:
    """The same for one ISO date or timestamp."""
    d = date.fromisoformat(text[:10])
    year, week, _ = d.isocalendar()
    keys = {"daily": d.isoformat(), "weekly": f"{year:04d}-W{week:02d}", "monthly": f"{d:%Y-%m}"}
    if cadence not in keys:
        raise ValueError(f"cadence must be daily, weekly or monthly: {cadence!r}")
    return keys[cadence]


def cadence_bucket(d: Column, cadence: str) -> Column:
    """The first day of the period that d is in."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}
    if cadence not in unit:
        raise ValueError(f"cadence must be daily, weekly or monthly: {cadence!r}")
    return F.date_trunc(unit[cadence], d).cast("date")


def request_key(tickers: Column, start: Column, end: Column) -> Column:
    """A request's cache key: the tickers in any order, start and end."""
    return F.substring(F.sha2(F.concat_ws("|", F.concat_ws(",", F.array_sort(tickers)), start, end), 256), 1, 16)


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected from the population's; null under three values."""
    return F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * g1)


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population's; null under four values."""
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * g2 + 6))
