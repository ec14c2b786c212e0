"""Column expressions with R-style missing-value rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Z975 = 1.959963984540054
CUBIC_METRES_PER_CUBIC_FOOT = 0.028316846592


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued: an unknown condition gives NULL, not ``no``."""
    return F.when(cond, yes).when(~cond, no)


def is_in(col: str | Column, values: Sequence) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


def recode(col: str | Column, mapping: Mapping) -> Column:
    """Replace listed values; others pass through."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(pairs[_c(col)], _c(col))


def classify(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule that holds labels the row; an unknown rule blanks the label, as nested if_else does."""
    out = F.lit(default)
    for cond, label in reversed(list(rules)):
        out = F.when(cond, F.lit(label)).when(~cond, out)
    return out


def null_if(col: str | Column, bad: Column) -> Column:
    """Blank sentinel values."""
    return F.when(~bad, _c(col))


def unite(*cols: str | Column, sep: str = "_") -> Column:
    """Paste columns together, a missing part showing as the text ``NA``."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def count_nulls(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def density(n: str | Column, length: str | Column) -> Column:
    """Count per unit length; NULL where the length is zero."""
    return F.try_divide(_c(n), _c(length))


def per_m2(per_m: str | Column, length: str | Column, area: str | Column) -> Column:
    return F.try_divide(_c(per_m) * _c(length), _c(area))


def per_100m(col: str | Column, length: str | Column) -> Column:
    return F.try_divide(_c(col), _c(length)) * 100


def explicit_missing(col: str | Column, label: str = "(Missing)") -> Column:
    return F.coalesce(_c(col), F.lit(label))


def last_rank(col: str | Column, level) -> Column:
    """Sort key that moves one level behind all others."""
    return F.when(_c(col).eqNullSafe(F.lit(level)), 1).otherwise(0)


def season_year(date: str | Column) -> Column:
    """Winter season label ``y-(y+1)``; the season turns after July."""
    y, m = F.year(_c(date)), F.month(_c(date))
    span = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    return if_else(m > 7, span(y, y + 1), span(y - 1, y))


def replace_year(date: str | Column, year: int) -> Column:
    d = _c(date)
    return F.make_date(F.lit(year), F.month(d), F.dayofmonth(d))


def parse_date(col: str | Column, fmt: str) -> Column:
    """NULL where the text does not fit the format."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("date")


def normal_ci(est: str | Column, se: str | Column, z: float = Z975,
              floor: float | None = None, cap: float | None = None) -> tuple[Column, Column]:
    low, high = _c(est) - F.lit(z) * _c(se), _c(est) + F.lit(z) * _c(se)
    if floor is not None:
        low = F.when(low < floor, F.lit(float(floor))).otherwise(low)
    if cap is not None:
        high = F.when(high > cap, F.lit(float(cap))).otherwise(high)
    return low, high


def cfs_to_cms(col: str | Column) -> Column:
    return _c(col) * F.lit(CUBIC_METRES_PER_CUBIC_FOOT)


def expand_by_fraction(count: str | Column, percent: str | Column) -> Column:
    """Count scaled up by the share sampled, rounded half to even; missing counts are zero."""
    return F.coalesce(F.bround(F.try_divide(_c(count), _c(percent) / 100), 0), F.lit(0.0))


def format_estimate(est: str | Column, cv: str | Column) -> Column:
    """``"1,234 (0.12)"``; a missing part shows as ``NA``, as pasted text does."""
    return F.concat(F.coalesce(F.format_number(F.bround(_c(est), 0), 0), F.lit("NA")), F.lit(" ("),
                    F.coalesce(F.when(_c(cv).isNotNull(), F.format_string("%.2f", F.bround(_c(cv), 2))), F.lit("NA")),
                    F.lit(")"))
