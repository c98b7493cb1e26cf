"""Structured cell masking by declared kind (M3), whole-value mask (M4), date to year (M5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P
from .text import mask_full


def date_to_year(value: Column, dtype=None, year_pivot: int = 2075) -> Column:
    """Year of a date-like value as a string; ``''`` if unparseable; blank strings returned as is.

    Native dates and timestamps give their year. Text loses a time of day (also after ``T``) and is read
    day first, then month first. A two-digit year is the one in the hundred years up to ``year_pivot``.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(value).cast("string")
    text = value.cast("string")
    date = F.regexp_replace(F.trim(text), P.TIME_TAIL, "")

    # The shape is tested once; day and month are then checked by arithmetic, so no cell is parsed by trial and error.
    # Lambdas name what is used again: written out as one expression, the generated code would not compile.
    def year_of(s):
        return F.when(s.rlike(P.DATE_DAY_FIRST), _bound(F.split(s, r"[/.\-]"), lambda p: day_first(s, p))).when(
            s.rlike(P.DATE_YEAR_FIRST), _bound(_numbers(F.split(s, "[/-]")), lambda n: F.when(_is_date(n[0], n[1], n[2]), n[0])))

    def day_first(s, p):
        digits = F.length(F.get(p, F.lit(2)))
        swaps = F.when(digits == 2, _has_any(s, P.MONTH_FIRST_SEPARATORS[2])).otherwise(_has_any(s, P.MONTH_FIRST_SEPARATORS[4]))

        def checked(n):
            full = F.when(digits == 2, 2000 + n[2]).otherwise(n[2])
            pivoted = F.lit(year_pivot) - F.pmod(F.lit(year_pivot) - full, F.lit(100))
            return F.when(_is_date(full, n[1], n[0]) | (swaps & _is_date(full, n[0], n[1])), F.when(digits == 2, pivoted).otherwise(full))

        return _bound(_numbers(p), checked)

    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.trim(text) == "", text)
        .otherwise(F.coalesce(_bound(date, year_of).cast("string"), F.lit("")))
    )


def _bound(value: Column, of) -> Column:
    """``of`` a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: x.try_cast("int"))


def _has_any(s: Column, marks: str) -> Column:
    return F.translate(s, marks, "") != s


def _is_date(year: Column, month: Column, day: Column) -> Column:
    """The day is one of the month (Gregorian calendar)."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= last)


def mask_struct_value(value: Column, kind: str, profile, dtype=None):
    """Return ``(masked_value, count)`` for one structured column of the given kind.

    keep/num/cat: unchanged, 0.  date: year, 1.  pii: ``[X]``, 1.  name: ``[NOMBRE]``, 1.
    Other kinds: the kind's profile regex replaced by its tag (count = matches); no pattern or no
    match gives ``[X]`` with count 1.  Null stays null with count 0.
    """
    strategy = profile.masking_strategy
    notnull = value.isNotNull()
    one = F.when(notnull, F.lit(1)).otherwise(F.lit(0))
    if kind in ("keep", "num", "cat"):
        return value, F.lit(0)
    if kind == "date":
        return date_to_year(value, dtype, profile.year_pivot), one
    if kind == "pii":
        return mask_full(value, strategy, "[X]"), one
    tag = P.KIND_TAGS.get(kind, "[X]")
    if kind == "name":
        return mask_full(value, strategy, tag), one
    pattern = profile.regex.get(kind) or profile.extra_regex.get(kind)
    s = value.cast("string")
    if not pattern:
        return mask_full(s, strategy, "[X]"), one
    jp = F.lit(P.ci(pattern))
    n = F.regexp_count(s, jp)
    masked = F.when(n > 0, F.regexp_replace(s, jp, F.lit(tag))).otherwise(mask_full(s, strategy, "[X]"))
    cnt = F.when(notnull, F.when(n > 0, n).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.when(notnull, masked), cnt.cast("int")
