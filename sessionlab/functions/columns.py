"""Column builders: flags, labels, calendar parts, pair features, moments. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- flags and labels ---------------------------------------------------------------------------

def presence_flag(c: ColumnLike) -> Column:
    return col(c).isNotNull().cast("int")


def equals_flag(c: ColumnLike, value) -> Column:
    """1 / 0; NULL stays NULL."""
    return (col(c) == F.lit(value)).cast("int")


def bool_to_int(c: ColumnLike) -> Column:
    return col(c).cast("int")


def na_to_null(c: ColumnLike, tokens: Sequence[str]) -> Column:
    return F.when(~col(c).isin(*tokens), col(c))


def clip_negative(c: ColumnLike) -> Column:
    return F.when(col(c) < 0, F.lit(0.0)).otherwise(col(c))


def zero_when(c: ColumnLike, condition: Column) -> Column:
    return F.when(condition, F.lit(0.0)).otherwise(col(c))


def binary_label(c: ColumnLike, threshold: float = 0.001) -> Column:
    return (F.coalesce(col(c).try_cast("double"), F.lit(0.0)) > threshold).cast("int")


def log_label(c: ColumnLike) -> Column:
    """log1p of revenue text; unreadable or missing revenue counts as 0."""
    return F.log1p(F.coalesce(col(c).try_cast("double"), F.lit(0.0)))


def natural_log(c: ColumnLike) -> Column:
    """Logarithm with log(0) = -Infinity (Spark's own gives NULL); NULL below zero."""
    return F.when(col(c) == 0, F.lit(float("-inf"))).otherwise(F.log(col(c)))


# --- text and dates -----------------------------------------------------------------------------

def cross_feature(a: ColumnLike, b: ColumnLike, sep: str = "_") -> Column:
    """NULL when either side is NULL."""
    return F.concat(col(a).cast("string"), F.lit(sep), col(b).cast("string"))


def cross_features(left: Sequence[str], right: Sequence[str]) -> dict[str, Column]:
    """Every pair of the two lists, for one ``withColumns``."""
    return {f"{a}_{b}": cross_feature(a, b) for a in left for b in right}


def paste_feature(a: ColumnLike, b: ColumnLike, sep: str = "_") -> Column:
    """NULL is written as the text NA, so the result is never NULL."""
    text = [F.coalesce(col(c).cast("string"), F.lit("NA")) for c in (a, b)]
    return F.concat_ws(sep, *text)


def parse_ymd(c: ColumnLike) -> Column:
    return F.try_to_date(col(c), "yyyyMMdd")


def epoch_to_ts(c: ColumnLike) -> Column:
    return F.timestamp_seconds(col(c))


def week_block(c: ColumnLike) -> Column:
    """Seven-day blocks counted from 1 January (not ISO weeks)."""
    return (F.floor((F.dayofyear(col(c)) - 1) / 7) + 1).cast("int")


def day_in_quarter(c: ColumnLike) -> Column:
    day = col(c).cast("date")
    return F.datediff(day, F.trunc(day, "quarter")) + 1


def calendar_parts(c: ColumnLike, hour: bool = True) -> dict[str, Column]:
    """year, month, day, wday (1 = Sunday), week, yday, qday and, for timestamps, hour."""
    c = col(c)
    parts = {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "wday": F.dayofweek(c),
        "week": week_block(c),
        "yday": F.dayofyear(c),
        "qday": day_in_quarter(c),
    }
    if hour:
        parts["hour"] = F.hour(c)
    return parts


# Calendar fields pasted into pair features, name -> (first, second).
CALENDAR_PAIRS = {
    "year_week": ("year", "week"),
    "year_wday": ("year", "wday"),
    "year_yday": ("year", "yday"),
    "year_qday": ("year", "qday"),
    "year_month": ("year", "month"),
    "month_wday": ("month", "wday"),
    "year_day": ("year", "day"),
    "hour_minute": ("hour", "minute"),
}


def calendar_pairs(names: Sequence[str] = tuple(CALENDAR_PAIRS)) -> dict[str, Column]:
    return {name: paste_feature(*CALENDAR_PAIRS[name]) for name in names}


def text_calendar(c: ColumnLike) -> dict[str, Column]:
    """Weekday name, two-digit hour and month as text."""
    c = col(c)
    return {
        "weekday_name": F.date_format(c, "EEEE"),
        "hour_text": F.date_format(c, "HH"),
        "month_text": F.date_format(c, "MM"),
    }


def round_result(c: ColumnLike, digits: int = 5) -> Column:
    """Half-even rounding, as the result files use."""
    return F.bround(col(c), digits)


# --- aggregates -----------------------------------------------------------------------------------

def skewness_type3(c: ColumnLike) -> Column:
    """Moment skewness with the sample variance in the denominator."""
    c, n = col(c), F.count(col(c)).cast("double")
    return F.skewness(c) * F.pow((n - 1) / n, F.lit(1.5))


def kurtosis_type3(c: ColumnLike) -> Column:
    """Excess kurtosis with the sample variance in the denominator."""
    c, n = col(c), F.count(col(c)).cast("double")
    return (F.kurtosis(c) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3


def distinct_with_null(c: ColumnLike) -> Column:
    """Distinct count in which NULL is one more value."""
    c = col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def rollup_log_sum(c: ColumnLike) -> Column:
    """log1p of the summed amounts, given their log1p."""
    return F.log1p(F.sum(F.expm1(col(c))))


def rmse(prediction: ColumnLike, label: ColumnLike) -> Column:
    return F.sqrt(F.avg(F.pow(col(prediction) - col(label), F.lit(2.0))))
