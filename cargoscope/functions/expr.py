"""Column expressions shared by all operators."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoscope.functions import constants as K

def null_double() -> Column:
    return F.lit(None).cast("double")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """Double, with NaN, infinities and unparsable text as NULL."""
    v = c(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def _units(x) -> Column:
    """Money in whole ten-thousandths, one rounding for all sizes; a value that is no number counts as absent."""
    return (finite(x).cast("decimal(28,4)") * F.lit(10_000)).cast("decimal(24,0)")


def _money(total: Column) -> Column:
    return (total * F.lit(Decimal("0.0001"))).cast("double")


def money_sum(x) -> Column:
    """Sum of a money column that does not depend on row order; NULL when no value is present."""
    return _money(F.sum(_units(x)))


def money_over(x, window) -> Column:
    """``money_sum`` over a window."""
    return _money(F.sum(_units(x)).over(window))


def money_sum0(x) -> Column:
    """As ``money_sum`` but 0 when no value is present."""
    return F.coalesce(money_sum(x), F.lit(0.0))


def cents(x) -> Column:
    """Prices quoted in cents as whole numbers; their sums are exact and cheap."""
    return F.floor(c(x) * 100 + 0.5)


def from_cents(x: Column) -> Column:
    return x / F.lit(100.0)


def sum_if(cond: Column, x) -> Column:
    return money_sum(F.when(cond, c(x)))


def sum_if0(cond: Column, x) -> Column:
    return F.coalesce(sum_if(cond, x), F.lit(0.0))


def pct(num, den) -> Column:
    n, d = c(num), c(den)
    return F.when(d != 0, 100 * n / d)


def pct_pos(num, den) -> Column:
    n, d = c(num), c(den)
    return F.when(d > 0, 100 * n / d)


def per_capita(num, pop) -> Column:
    n, p = c(num), c(pop)
    return F.when(p > 0, n / p)


def growth_pct(curr, prev) -> Column:
    a, b = c(curr), c(prev)
    return F.when(b != 0, 100 * (a - b) / b)


def clamp(x, lo: float, hi: float) -> Column:
    v = c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def is_iso3(x) -> Column:
    return F.coalesce(c(x).rlike("^[A-Z]{3}$"), F.lit(False))


def blank_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(""))


def has_text(x) -> Column:
    return F.coalesce(F.trim(c(x)) != "", F.lit(False))


def in_set(x, values) -> Column:
    """Membership test that is FALSE, never NULL, for a NULL value."""
    return F.coalesce(c(x).isin(list(values)), F.lit(False))


def flow_label(x) -> Column:
    code = c(x)
    return (
        F.when(code.isin("M", "Import", "Imports"), "Imports")
        .when(code.isin("X", "Export", "Exports"), "Exports")
        .otherwise(code)
    )


def band(x, steps, top: str) -> Column:
    """Half-open bands: the first upper limit above the value names it."""
    v = finite(x)
    chain = F.when(v.isNull() | (v < 0), F.lit(K.BAND_MISSING))
    for limit, label in steps:
        chain = chain.when(v < limit, F.lit(label))
    return chain.otherwise(F.lit(top))


def hhi_band(x) -> Column:
    return band(x, K.HHI_BANDS, K.HHI_BANDS[-1][1])


def share_band(x) -> Column:
    return band(x, K.SHARE_BANDS, K.SHARE_BANDS[-1][1])


def series_id(reporter, partner, hs, flow) -> Column:
    return F.concat_ws("__", c(reporter), c(partner), c(hs), c(flow))


def series_part(sid, name: str) -> Column:
    position = K.SERIES_PARTS.index(name) + 1
    return F.try_element_at(F.split(c(sid), "__"), F.lit(position))


def node_id(iso3, hs) -> Column:
    return F.concat_ws("::", c(iso3), c(hs))


def node_part(nid, name: str) -> Column:
    return F.try_element_at(F.split(c(nid), "::"), F.lit(K.NODE_PARTS.index(name) + 1))


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def log_transform(x, transform: str) -> Column:
    v = c(x)
    return F.when(v.isNotNull(), F.log1p(F.greatest(F.lit(0.0), v))) if transform == "log1p" else v


def log_inverse(x, transform: str) -> Column:
    v = c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.expm1(v))) if transform == "log1p" else v


def null_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def null_max(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def month_tokens(start_year: int, end_year: int) -> Column:
    """Array of month starts; explode it for a calendar."""
    return F.sequence(
        F.make_date(F.lit(start_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(end_year), F.lit(12), F.lit(1)),
        F.expr("interval 1 month"),
    )


def period_token(date) -> Column:
    return F.date_format(c(date), "yyyyMM")
