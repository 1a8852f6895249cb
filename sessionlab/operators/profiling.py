"""Table profiles: the aggregates behind missing-value, frequency, histogram and correlation plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.operators.cleaning import columns_of, quoted, value_frequencies
from sessionlab.operators.skew import global_quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """(column, null_share), from one aggregate."""
    shares = df.agg(*[F.avg(quoted(c).isNull().cast("int")).alias(c) for c in df.columns])
    return shares.unpivot([], [quoted(c) for c in df.columns], "column", "null_share")


def five_number(df: DataFrame, column: str) -> DataFrame:
    """min, quartiles, mean, max of one column, exact."""
    quartiles = global_quantiles(df, column, [0.25, 0.5, 0.75]) or [None] * 3
    q = quoted(column)
    q1, median, q3 = (F.lit(v).cast("double") for v in quartiles)
    return df.agg(F.min(q).alias("min"), F.avg(q).alias("mean"), F.max(q).alias("max")).select(
        "min", q1.alias("q1"), median.alias("median"), "mean", q3.alias("q3"), "max")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of the categorical columns."""
    return value_frequencies(df, columns or columns_of(df, T.StringType))


def histogram(df: DataFrame, bins: int = 30, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, bin, n): equal-width bins between each column's min and max, the max in the last bin.
    Two passes: the ranges, as literals, and the counts."""
    columns = list(columns or columns_of(df, T.NumericType))
    values = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    ends = values.agg(*[f(quoted(c)) for c in columns for f in (F.min, F.max)]).first()
    ranges = {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(columns)}
    binned = values.select(*[_bin(c, *ranges[c], bins).alias(c) for c in columns])
    long = binned.unpivot([], [quoted(c) for c in columns], "column", "bin")
    return long.filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def _bin(c: str, low: float | None, high: float | None, bins: int) -> Column:
    if low is None or low == high:
        inside = F.lit(1)
    else:
        position = F.floor((quoted(c) - F.lit(low)) / F.lit(high - low) * bins) + 1
        inside = F.least(position, F.lit(bins))  # least skips NULL
    return F.when(quoted(c).isNotNull(), inside).cast("int")


_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab", "bad")


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair of numeric columns: Pearson over rows where both are present, NULL where that is undefined.

    Every task multiplies blocks of rows, as matrices of values and of presence: the products hold the sums of all pairs at
    once, so a hundred columns cost one pass and the same few aggregates as two. Values are taken from the columns' means,
    which keeps the sums of squares apart from rounding. A NaN makes the pairs that meet it NaN.
    """
    columns = list(columns or columns_of(df, T.NumericType))
    values = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.when(~F.isnan(f"c{i}") & (F.abs(f"c{i}") < float("inf")), F.col(f"c{i}")) for i in range(len(columns))]
    means = np.array([m or 0.0 for m in values.agg(*[F.avg(c) for c in finite]).first()])
    left, right = np.triu_indices(len(columns), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(means)
        total = np.zeros((5, size, size))
        for batch in batches:
            x = np.column_stack([pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False) for c in batch.columns])
            there = np.column_stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            odd = there * ~np.isfinite(x)
            x = np.where(np.isfinite(x), x - means, 0.0)
            for k, (p, q) in enumerate(((there, there), (x, there), (x * x, there), (x, x), (odd, there))):
                total[k] += p.T @ q
        n, one, two, both, odd = total
        sums = (n, one, one.T, two, two.T, both, odd + odd.T)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left), pa.array(right), *[pa.array(np.ascontiguousarray(m[left, right])) for m in sums]], names=["a", "b", *_SUMS])
    parts = values.mapInArrow(run, "a long, b long, " + ", ".join(f"{c} double" for c in _SUMS))
    pair = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    own_a, own_b = (F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab")
    # What rounding leaves of a constant column's variance is no variance.
    varies = (own_a > 1e-12 * F.col("saa")) & (own_b > 1e-12 * F.col("sbb"))
    r = F.when(F.col("bad") > 0, F.lit(float("nan"))).when(
        (F.col("n") > 1) & varies, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(own_a * own_b))
    names = F.array(*[F.lit(c) for c in columns])
    return pair.select(F.get(names, F.col("a").cast("int")).alias("a"), F.get(names, F.col("b").cast("int")).alias("b"), r.alias("r"))


TOP_VALUES = 10


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, distinct, most frequent value and its count, the ten most frequent values with
    their counts (``top_values``, as value: count lines), and min, mean, sd, max of numbers.

    Values are counted with partial results in the map tasks; of the counts, each task keeps ten per column before they
    are ranked."""
    numeric = set(columns_of(df, T.NumericType))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(quoted(c)).alias(f"_n{i}"))
        if c in numeric:
            x = quoted(c).cast("double")
            aggs += [F.min(x).alias(f"_min{i}"), F.avg(x).alias(f"_avg{i}"),
                     F.stddev_samp(x).alias(f"_sd{i}"), F.max(x).alias(f"_max{i}")]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("missing"),
            *[(F.col(f"_{k}{i}") if c in numeric else none).alias(name)
              for k, name in (("min", "min"), ("avg", "mean"), ("sd", "sd"), ("max", "max"))],
        )
        for i, c in enumerate(df.columns)
    ]
    basics = df.agg(*aggs).select(F.inline(F.array(*rows)))
    counts = value_frequencies(df)
    first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= TOP_VALUES)
    line = F.concat("value", F.lit(": "), F.col("n").cast("string"))
    top = ranked.groupBy(F.col("column").alias("_c")).agg(
        F.min_by("value", "_r").alias("top"), F.max("n").alias("top_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"]), "\n").alias("top_values"))
    distinct = counts.groupBy(F.col("column").alias("_d")).agg(F.count(F.lit(1)).alias("distinct"))
    return (
        basics.join(top, F.col("column") == F.col("_c"), "left").join(distinct, F.col("column") == F.col("_d"), "left")
        .select("column", "type", "n_rows", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"),
                "top", "top_n", "top_values", "min", "mean", "sd", "max")
    )
