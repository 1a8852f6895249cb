"""Features from a visitor's neighbouring sessions, numbering, and group values on every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlab.operators.aggregates import attach_distinct_counts, stats_by
from sessionlab.operators.cleaning import quoted
from sessionlab.operators.joins import bounded, left_join_nullsafe
from sessionlab.operators.skew import neighbours_in_order, number_in_order


def _own(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def neighbour_sessions(df: DataFrame, visitor: str, start: str, tie: Sequence[str], n: int = 2,
                       unit: float = 3600.0, gaps: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Start times of the visitor's n previous and n next sessions in hours since the epoch
    (``prev_start_k``, ``next_start_k``); with ``gaps`` the distance to the row's own start instead
    (``prev_gap_k``, ``next_gap_k``). ``start`` is in epoch seconds. Previous means earlier."""
    out = neighbours_in_order(df, visitor, start, tie, n, n, hot_rows)
    exprs: dict[str, Column] = {}
    for k in range(1, n + 1):
        before, after = F.col(f"prev_{k}"), F.col(f"next_{k}")
        if gaps:
            exprs[f"prev_gap_{k}"] = (quoted(start) - before) / F.lit(unit)
            exprs[f"next_gap_{k}"] = (after - quoted(start)) / F.lit(unit)
        else:
            exprs[f"prev_start_{k}"] = before / F.lit(unit)
            exprs[f"next_start_{k}"] = after / F.lit(unit)
    return out.select(*_own(df), *[e.alias(name) for name, e in exprs.items()])


def neighbour_session(df: DataFrame, visitor: str, start: str, tie: Sequence[str],
                      fun: Callable[[str, int], Column], n: int, name: str) -> DataFrame:
    """One neighbour, chosen by ``F.lag`` or ``F.lead`` (the higher-order form)."""
    before = fun is F.lag
    out = neighbours_in_order(df, visitor, start, tie, n if before else 0, 0 if before else n)
    value = F.col(f"prev_{n}" if before else f"next_{n}") / F.lit(3600.0)
    return out.select(*_own(df), value.alias(name))


def session_gap(df: DataFrame, visitor: str, start: str, tie: Sequence[str], divisor: float = 3600.0,
                name: str = "gap") -> DataFrame:
    """Time to the visitor's next session."""
    out = neighbours_in_order(df, visitor, start, tie, 0, 1)
    return out.select(*_own(df), ((F.col("next_1") - quoted(start)) / F.lit(divisor)).alias(name))


def gap_neighbours(df: DataFrame, visitor: str, start: str, tie: Sequence[str],
                   divisor: float = 3600.0) -> DataFrame:
    """The gap after the next session and the gap before this one: lead and lag of ``session_gap``.
    Both follow from the starts of three neighbours, so one sort is enough."""
    out = neighbours_in_order(df, visitor, start, tie, 1, 2)
    return out.select(
        *_own(df),
        ((F.col("next_2") - F.col("next_1")) / F.lit(divisor)).alias("gap_lead"),
        ((quoted(start) - F.col("prev_1")) / F.lit(divisor)).alias("gap_lag"),
    )


def group_broadcast(df: DataFrame, key: str, measures: Sequence[str], stats: Sequence[str],
                    keep_ungrouped: bool = False, key_rows: int | None = None) -> DataFrame:
    """Statistics of the row's group on each row, as ``<measure>_<stat>_<key>``.

    Aggregate and join back rather than a window: the rows are not shuffled when the groups can be
    broadcast, and a hot key costs no more than any other. With ``keep_ungrouped`` rows whose key is
    NULL keep the measure itself in place of a statistic."""
    grouped = stats_by(df, [key], measures, stats).withColumnsRenamed(
        {f"{m}_{s}": f"{m}_{s}_{key}" for m in measures for s in stats})
    out = left_join_nullsafe(df, grouped, key, right_rows=key_rows)
    if keep_ungrouped:
        out = out.withColumns({
            f"{m}_{s}_{key}": F.when(quoted(key).isNull(), quoted(m).cast("double")).otherwise(quoted(f"{m}_{s}_{key}"))
            for m in measures for s in stats})
    return out


def distinct_broadcast(df: DataFrame, keys: Sequence[str], column: str, suffix: str = "_user_cnt") -> DataFrame:
    return attach_distinct_counts(df, keys, column, suffix)


def row_number_per_key(df: DataFrame, key: str, order: str, tie: Sequence[str], name: str = "n") -> DataFrame:
    return number_in_order(df, key, order, tie, name)


def first_n_per_key(df: DataFrame, key: str, order: str, tie: Sequence[str], n: int = 30,
                    name: str = "n") -> DataFrame:
    """The first n rows of each key, numbered. Spark limits each task to n rows per key before the
    shuffle, so hot keys need no slices here."""
    w = Window.partitionBy(quoted(key)).orderBy(*[quoted(c) for c in (order, *tie)])
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def day_ordinal(df: DataFrame, day: str, name: str = "day_no") -> DataFrame:
    """Number of the row's day among the days that occur, from 1. Only the distinct days (a calendar's
    worth, whatever the data size) are ranked and counted; then they are joined back."""
    day_value = quoted(day).cast("date")
    days = df.select(day_value.alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    ranked = days.select(F.col("_day"), F.row_number().over(Window.orderBy("_day")).alias(name))
    return df.join(bounded(ranked, days.count()), day_value == F.col("_day"), "left").drop("_day")
