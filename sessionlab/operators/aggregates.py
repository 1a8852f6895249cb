"""Group statistics. Everything is a built-in aggregate with partial results in the map tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.functions.columns import (
    distinct_with_null,
    kurtosis_type3,
    rmse,
    rollup_log_sum,
    skewness_type3,
)
from sessionlab.operators.cleaning import quoted
from sessionlab.operators.joins import bounded, left_join_nullsafe
from sessionlab.operators.skew import COUNTER_VALUES, exact_quantiles
from sessionlab.session import cut_lineage

STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "sd": F.stddev_samp,
    "var": F.var_samp,
    "skewness": skewness_type3,
    "kurtosis": kurtosis_type3,
    "min": F.min,
    "max": F.max,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "n_distinct": F.count_distinct,
    "count": F.count,
}


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*_all(keys)).agg(F.count(F.lit(1)).alias(name))


def _all(names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names]


def stats_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str], stats: Sequence[str],
             wide: set[str] | None = None) -> DataFrame:
    """Named statistics of each measure per group, as ``<measure>_<stat>``. Exact medians switch to the
    distributed method when a measure has too many values for per-group counters; ``wide`` names such
    measures if the caller knows them already."""
    keys, stats = list(keys), list(stats)
    spread = set() if "median" not in stats else _wide_measures(df, measures) if wide is None else wide
    aggs = [
        STATS[s](quoted(m)).alias(f"{m}_{s}")
        for m in measures for s in stats if not (s == "median" and m in spread)
    ]
    out = df.groupBy(*_all(keys)).agg(*aggs) if aggs else df.select(*_all(keys)).distinct()
    if spread:
        halves = exact_quantiles(df, keys, sorted(spread), [0.5])
        out = left_join_nullsafe(out, halves.withColumnsRenamed({f"{m}_0": f"{m}_median" for m in spread}), keys)
    return out.select(*_all(keys), *_all([f"{m}_{s}" for m in measures for s in stats]))


def _wide_measures(df: DataFrame, measures: Sequence[str]) -> set[str]:
    row = df.agg(*[F.approx_count_distinct(quoted(m)).alias(f"_{i}") for i, m in enumerate(measures)]).first()
    return {m for m, n in zip(measures, row) if n > COUNTER_VALUES}


def sum_by(df, keys, measures):
    return stats_by(df, keys, measures, ["sum"])


def mean_by(df, keys, measures):
    return stats_by(df, keys, measures, ["mean"])


def min_by(df, keys, measures):
    return stats_by(df, keys, measures, ["min"])


def max_by(df, keys, measures):
    return stats_by(df, keys, measures, ["max"])


def sd_by(df, keys, measures):
    return stats_by(df, keys, measures, ["sd"])


def var_by(df, keys, measures):
    return stats_by(df, keys, measures, ["var"])


def median_by(df, keys, measures):
    return stats_by(df, keys, measures, ["median"])


def skewness_by(df, keys, measures):
    return stats_by(df, keys, measures, ["skewness"])


def kurtosis_by(df, keys, measures):
    return stats_by(df, keys, measures, ["kurtosis"])


def distinct_by(df: DataFrame, keys: Sequence[str], column: str, count_null: bool = True,
                name: str = "n_distinct") -> DataFrame:
    """Distinct values per group. Spark first removes duplicates on (keys, value), so a hot group is
    spread over tasks by its values."""
    expr = distinct_with_null(quoted(column)) if count_null else F.count_distinct(quoted(column))
    return df.groupBy(*_all(keys)).agg(expr.alias(name))


#: Buckets of a distinct-count sketch, as a power of two, and its relative standard error.
SKETCH_LOG = 12
SKETCH_ERROR = 0.83 / 2 ** (SKETCH_LOG / 2)


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str, name: str = "sketch") -> DataFrame:
    """A mergeable sketch of the distinct values per group (NULL does not count), for tables that grow: store one per key and
    day, and merge the days that are wanted. Exact counts are ``distinct_by``; this trades them for ``SKETCH_ERROR``."""
    text = F.coalesce(quoted(column).cast("string"), F.lit(""))
    # The sketch takes no NULL; a group of nothing but NULLs keeps an empty one.
    return df.groupBy(*_all(keys)).agg(F.hll_sketch_agg(F.when(quoted(column).isNotNull(), text), F.lit(SKETCH_LOG)).alias(name))


def merged_distinct(sketches: DataFrame, keys: Sequence[str], sketch: str = "sketch", name: str = "estimate") -> DataFrame:
    """Estimated distinct values per group of stored sketches, whatever finer groups they were made for."""
    return sketches.groupBy(*_all(keys)).agg(F.hll_sketch_estimate(F.hll_union_agg(quoted(sketch))).alias(name))


def count_nonnull_by(df: DataFrame, keys: Sequence[str], column: str, name: str = "n") -> DataFrame:
    return df.groupBy(*_all(keys)).agg(F.count(quoted(column)).alias(name))


# --- many keys at once --------------------------------------------------------------------------------

def fit_key_sizes(df: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Estimated number of groups per key, all keys in one pass of mergeable sketches. The estimate is
    raised by 20 percent (four standard errors) to serve as a bound for broadcasts."""
    row = df.agg(*[F.approx_count_distinct(quoted(k)).alias(f"_{i}") for i, k in enumerate(keys)]).first()
    return {k: int(n * 1.2) + 2 for k, n in zip(keys, row)}


def long_group_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str], stats: Sequence[str],
                     wide: set[str] | None = None) -> DataFrame:
    """(key_name, key_value, statistics): the groups of every key from one scan and one shuffle of
    partial aggregates."""
    text = df.select(*[quoted(k).cast("string").alias(k) for k in keys],
                     *[quoted(m).alias(f"_m_{m}") for m in measures])
    long = text.unpivot(_all([f"_m_{m}" for m in measures]), [quoted(k) for k in keys], "key_name", "key_value")
    long = long.withColumnsRenamed({f"_m_{m}": m for m in measures})
    return stats_by(long, ["key_name", "key_value"], measures, stats, wide)


def attach_group_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str], stats: Sequence[str],
                       name: str = "{measure}_{stat}_{key}", sizes: dict[str, int] | None = None) -> DataFrame:
    """For every key, the statistics of each measure in the row's group, on each row. NULL is a group.

    The statistics of all keys come from one job and are written out once; each key is then a broadcast
    join if its number of groups allows, else a sort-merge join. Only statistics are shuffled, never
    the rows of a broadcast key."""
    sizes = sizes or fit_key_sizes(df, [*keys, *measures])
    wide = {m for m in measures if sizes[m] > COUNTER_VALUES}
    stats_table = cut_lineage(long_group_stats(df, keys, measures, stats, wide))
    named = {key: {f"{m}_{s}": name.format(measure=m, stat=s, key=key) for m in measures for s in stats} for key in keys}
    return _attach_by_key(df, stats_table, named, sizes)


def _attach_by_key(df: DataFrame, table: DataFrame, named: Mapping[str, Mapping[str, str]],
                   sizes: Mapping[str, int]) -> DataFrame:
    """Left join of each key's rows of a (key_name, key_value, ...) table; NULL keys match. One join node per
    key and one projection at the end keep the plan small when there are dozens of keys."""
    out = df
    for i, (key, columns) in enumerate(named.items()):
        side = table.filter(F.col("key_name") == key).select(
            F.col("key_value").alias(f"_gk{i}"), *[quoted(c).alias(new) for c, new in columns.items()])
        out = out.join(bounded(side, sizes[key], len(named)), quoted(key).cast("string").eqNullSafe(F.col(f"_gk{i}")), "left")
    added = [new for columns in named.values() for new in columns.values()]
    return out.select(*[quoted(c) for c in df.columns], *[quoted(c) for c in added])


def attach_distinct_counts(df: DataFrame, keys: Sequence[str], column: str, suffix: str = "_user_cnt",
                           sizes: dict[str, int] | None = None) -> DataFrame:
    """Distinct values of ``column`` in the row's group, per key, on each row (a window cannot count
    distinct values). One job for all keys; NULL keys are a group and a NULL value counts."""
    sizes = sizes or fit_key_sizes(df, keys)
    long = df.select(quoted(column).alias("_v"), *[quoted(k).cast("string").alias(k) for k in keys]).unpivot(
        ["_v"], [quoted(k) for k in keys], "key_name", "key_value")
    counts = cut_lineage(distinct_by(long, ["key_name", "key_value"], "_v"))
    return _attach_by_key(df, counts, {k: {"n_distinct": f"{k}{suffix}"} for k in keys}, sizes)


# --- roll-ups ------------------------------------------------------------------------------------------

def mean_all_by(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Average of every numeric feature per key."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != key]
    return df.groupBy(quoted(key)).agg(*[F.avg(quoted(c)).alias(c) for c in columns])


def rollup_by(df: DataFrame, key: str, y: str, name: str = "y") -> DataFrame:
    return df.groupBy(quoted(key)).agg(rollup_log_sum(y).alias(name))


def pivot_wide(df: DataFrame, key: str, number: str, value: str, count: int, prefix: str = "pred") -> DataFrame:
    """``pred1 .. predN`` per key. The pivot values are given, so no job runs to find them."""
    cells = df.select(quoted(key), quoted(number).alias("_number"), quoted(value).alias("_value"))
    wide = cells.groupBy(quoted(key)).pivot("_number", list(range(1, count + 1))).agg(F.first("_value"))
    return wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(1, count + 1)})


ROW_STATS: Mapping[str, Callable[[Column], Column]] = {
    "p_mean": F.avg,
    "p_med": F.median,
    "p_sd": F.stddev_samp,
    "p_sum": F.sum,
    "p_min": F.min,
    "p_max": F.max,
}


def rowwise_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """The statistics across ``pred1 .. predN`` of a key, taken from the at most N long rows that the
    pivot is made of: same values, no row loop."""
    return df.groupBy(quoted(key)).agg(*[fn(quoted(value)).alias(name) for name, fn in ROW_STATS.items()])


def error_of(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(rmse(prediction, label).alias("rmse"))


def row_count(df: DataFrame) -> DataFrame:
    """Rows and columns, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
