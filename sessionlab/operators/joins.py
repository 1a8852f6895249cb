"""Joins and stacking. A side is broadcast only when the caller knows a bound for its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.operators.cleaning import quoted
from sessionlab.operators.skew import BROADCAST_ROWS


# Bytes of all sides that one step broadcasts together, and what a value of variable length is taken for.
BROADCAST_BYTES = 64 << 20
TEXT_BYTES = 200


def bounded(df: DataFrame, rows: int | None, sides: int = 1) -> DataFrame:
    """Broadcast hint when ``rows`` is a known bound below the limit, in rows and, with the width of the columns, in this
    side's part of the bytes that ``sides`` broadcasts may take together; otherwise leave the choice to adaptive
    execution, which measures the side and splits skewed partitions of a sort-merge join."""
    if rows is None or rows > BROADCAST_ROWS:
        return df
    width = sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else TEXT_BYTES for f in df.schema.fields)
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES // max(1, sides) else df


def _nullsafe(left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [quoted(a).eqNullSafe(quoted(b)) for a, b in zip(left_keys, right_keys)])


def left_join_nullsafe(left: DataFrame, right: DataFrame, keys: str | Sequence[str], suffix: str = "_r",
                       right_rows: int | None = None) -> DataFrame:
    """Left join in which NULL keys match NULL keys; right columns that clash get the suffix."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    temp = {k: f"_rk_{k}" for k in keys}
    renamed = {c: c + suffix for c in right.columns if c not in keys and c in left.columns}
    side = right.withColumnsRenamed(temp | renamed)
    joined = left.join(bounded(side, right_rows), _nullsafe(keys, list(temp.values())), "left")
    return joined.drop(*temp.values())


def left_join_multi(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_r",
                    right_rows: int | None = None) -> DataFrame:
    """Null-safe left join on several keys."""
    return left_join_nullsafe(left, right, keys, suffix, right_rows)


def right_join_template(predictions: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Every row of the template, with its prediction or NULL. The key must be a string on both sides."""
    return predictions.join(template.select(key), key, "right")


def left_join_template(template: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    return template.select(key).join(predictions, key, "left")


def multi_left_join(frames: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Chain of left joins on one key; the value column of frame i becomes ``value_i`` (from 1).

    All joins hash on the same key, so each input is shuffled once and the running result not again."""
    named = [f.select(quoted(key), quoted(value).alias(f"{value}_{i}")) for i, f in enumerate(frames, 1)]
    return reduce(lambda a, b: a.join(b, key, "left"), named)


def zip_by_row_id(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Glue two tables side by side on a stored row id (never on file position)."""
    return left.join(right, row_id, "left")


def period_lookup(df: DataFrame, day: str | Column, periods: Sequence[tuple[str, str, int]],
                  name: str = "period") -> DataFrame:
    """Number of the half-open day range [start, end) a date falls in; NULL outside all ranges.

    A handful of ranges is a CASE over literals: no join, and Catalyst folds it into the scan stage."""
    day = F.col(day) if isinstance(day, str) else day
    branches = [((day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date")), n) for a, b, n in periods]
    expr = F.when(branches[0][0], F.lit(branches[0][1]))
    for condition, number in branches[1:]:
        expr = expr.when(condition, F.lit(number))
    return df.withColumn(name, expr)


def union_fill(first: DataFrame, *others: DataFrame, sort_columns: bool = False) -> DataFrame:
    """Stack by column name, NULL where a table lacks a column; optionally columns in name order."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
    return out.select(*sorted(out.columns)) if sort_columns else out


def align_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns they share, in the order of the first."""
    shared = name_intersect(a.columns, b.columns)
    return a.select(*shared), b.select(*shared)


def name_intersect(a: Sequence[str], b: Sequence[str]) -> list[str]:
    present = set(b)
    return [c for c in a if c in present]
