"""Column -> Column building blocks of the pricing rule and of the metrics.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pricing rule; they must equal the reference's for the
# same prices: popularity rank <= 3 -> 1.2, rank 4..10 -> 1.1, otherwise 0.9;
# stock rank <= 3 -> 1.1, rank 4..10 -> 1.05, otherwise 1; a product whose
# name matches '%cheap%' (any case) -> 0.8, otherwise 1.0; promotion
# discounts are percentages; the recent-price average uses the 10 newest sales.
POPULARITY_BANDS = ((3, 1.2), (10, 1.1))
POPULARITY_OTHERWISE = 0.9
STOCK_BANDS = ((3, 1.1), (10, 1.05))
STOCK_OTHERWISE = 1.0
CHEAP_PATTERN = "%cheap%"
CHEAP_FACTOR = 0.8
NAME_OTHERWISE = 1.0
RECENT_SALES = 10

# Fixed values of the freshness display: lag below 1 s is Low, below 5 s
# Medium, otherwise High; no reading is Unknown.
LAG_BANDS = ((1.0, "Low"), (5.0, "Medium"))
LAG_OTHERWISE = "High"
LAG_UNKNOWN = "Unknown"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(rank, bands: Sequence[tuple[int, float]], otherwise: float) -> Column:
    """Rank band with BETWEEN semantics: rank <= e1 -> f1, e1 < rank <= e2 -> f2 ..."""
    rank = _c(rank)
    expr = None
    lower = None
    for edge, factor in bands:
        cond = rank <= edge if lower is None else rank.between(lower + 1, edge)
        expr = F.when(cond, F.lit(factor)) if expr is None else expr.when(cond, F.lit(factor))
        lower = edge
    return expr.otherwise(F.lit(otherwise))


def band_by_threshold(value, thresholds: Sequence, factors: Sequence[float],
                      otherwise: float) -> Column:
    """Same band as :func:`band` for a descending rank, written without the rank.

    ``thresholds[i]`` is the k_i-th largest value counting duplicates (NULL when
    fewer than k_i values exist). For a descending RANK, ``rank <= k`` holds
    exactly when ``value >= t_k``, so the rank itself is never materialised.
    """
    value = _c(value)
    expr = None
    for t, factor in zip(thresholds, factors):
        t = _c(t)
        cond = value.isNotNull() & (t.isNull() | (value >= t))
        expr = F.when(cond, F.lit(factor)) if expr is None else expr.when(cond, F.lit(factor))
    return expr.otherwise(F.lit(otherwise))


def popularity_factor(rank) -> Column:
    return band(rank, POPULARITY_BANDS, POPULARITY_OTHERWISE)


def stock_factor(rank) -> Column:
    """NULL rank (no inventory) falls to the otherwise branch."""
    return band(rank, STOCK_BANDS, STOCK_OTHERWISE)


def promo_factor(pct) -> Column:
    """1 - pct/100, or 1 without an active promotion."""
    return F.coalesce(F.lit(1.0) - _c(pct).cast("double") / F.lit(100.0), F.lit(1.0))


def demand_factor(base, avg) -> Column:
    """base / avg; NULL when the average is NULL or zero (never raises)."""
    return F.try_divide(_c(base).cast("double"), _c(avg))


def name_factor(name, pattern: str = CHEAP_PATTERN) -> Column:
    return F.when(_c(name).ilike(pattern), F.lit(CHEAP_FACTOR)).otherwise(F.lit(NAME_OTHERWISE))


def live_price(*factors) -> Column:
    """Left-to-right product in double, rounded to 6 places, as decimal(20,6)."""
    cols = [_c(f).cast("double") for f in factors]
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return F.round(out, 6).cast("decimal(20,6)")


def money(col, precision: int = 20, scale: int = 10, digits: int = 2) -> Column:
    """Cast to numeric(p,s) then round half-up to ``digits``."""
    return F.round(_c(col).cast(f"decimal({precision},{scale})"), digits)


def lag_band(seconds) -> Column:
    s = _c(seconds)
    expr = F.when(s.isNull(), F.lit(LAG_UNKNOWN))
    for edge, label in LAG_BANDS:
        expr = expr.when(s < edge, F.lit(label))
    return expr.otherwise(F.lit(LAG_OTHERWISE))


def seconds_between(later, earlier) -> Column:
    """EXTRACT(EPOCH FROM later - earlier) as double seconds."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(1e6)


def millis_between(later, earlier) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(1e3)


def parse_ids(text) -> Column:
    """Comma separated text -> array of bigint, keeping only integer tokens."""
    tokens = F.split(F.coalesce(_c(text), F.lit("")), ",")
    trimmed = F.transform(tokens, lambda t: F.trim(t))
    return F.transform(F.filter(trimmed, lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("bigint"))
