"""Column selection and cleaning. Steps whose output schema depends on the data are a ``fit_*`` that
returns a list of names (one aggregate job) and a plain ``select`` / ``drop``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.functions.columns import na_to_null


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def derive(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns in one projection."""
    return df.withColumns(dict(exprs))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def columns_of(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def mutate_by_type(df: DataFrame, kinds: type[T.DataType] | tuple[type[T.DataType], ...],
                   fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one function to every column of a type."""
    kinds = kinds if isinstance(kinds, tuple) else (kinds,)
    hit = set(columns_of(df, *kinds))
    return df.select(*[fn(quoted(c)).alias(c) if c in hit else quoted(c) for c in df.columns])


def na_tokens_to_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Texts that mean "missing" become NULL in every string column."""
    return mutate_by_type(df, T.StringType, lambda c: na_to_null(c, tokens))


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def cast_cols(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Casts that give NULL on bad text instead of failing the job."""
    return df.withColumns({c: quoted(c).try_cast(kind) for c, kind in kinds.items()})


def date_filter(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open day range [start, end); compares the bare column, so it reaches the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end).cast(df.schema[column].dataType))
    return df


def tag_source(df: DataFrame, is_test: bool, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, F.lit(is_test))


def row_range(df: DataFrame, test: bool, name: str = "is_test") -> DataFrame:
    """Train or test rows of a stacked table, by its origin column (never by row number)."""
    return df.filter(F.col(name) if test else ~F.col(name))


# --- data-dependent column selection --------------------------------------------------------------

def fit_varying_cols(df: DataFrame) -> list[str]:
    """Columns with more than one distinct value, NULL counted as a value.

    Two values exist when min and max differ, or when NULLs and values mix: one pass of mergeable
    aggregates, no distinct."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        q = _comparable(df, c)
        aggs += [F.count(q).alias(f"n{i}"), F.min(q).alias(f"lo{i}"), F.max(q).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns)
            if 0 < row[f"n{i}"] < row["rows"] or _differ(row[f"lo{i}"], row[f"hi{i}"])]


def _differ(low, high) -> bool:
    both_nan = low != low and high != high
    return low != high and not both_nan


def drop_constant_cols(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in fit_varying_cols(df)])


def fit_dense_cols(df: DataFrame, max_null_share: float = 0.999) -> list[str]:
    """Columns whose NULL share does not exceed the limit."""
    row = df.agg(F.count(F.lit(1)), *[F.count(quoted(c)) for c in df.columns]).first()
    return [c for c, present in zip(df.columns, row[1:]) if row[0] - present <= max_null_share * row[0]]


def drop_sparse_cols(df: DataFrame, max_null_share: float = 0.999) -> DataFrame:
    return df.select(*[quoted(c) for c in fit_dense_cols(df, max_null_share)])


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of every non-NULL value of the columns, values as text: one scan, one shuffle
    with partial counts."""
    columns = list(columns or df.columns)
    text = df.select(*[_text(df, c).alias(c) for c in columns])
    long = text.unpivot([], [quoted(c) for c in columns], "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_near_zero_var(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """(column, top, second, distinct, drop): a column goes when it is constant, or when its top value
    is more than ``freq_cut`` times as frequent as the second and distinct values are at most
    ``unique_cut`` percent of the rows. One row per column.

    The two largest counts come from row_number <= 2, which Spark applies inside each task before the
    shuffle, so a column with billions of values does not land in one task."""
    counts = value_frequencies(df)
    by_size = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("r", F.row_number().over(by_size)).filter(F.col("r") <= 2).groupBy("column").agg(
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("top"),
        F.max(F.when(F.col("r") == 2, F.col("n"))).alias("second"),
    )
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column"))
    stats = names.join(top, "column", "left").join(distinct, "column", "left")
    distinct_pct = F.coalesce("distinct", F.lit(0)) * 100.0 / F.col("rows")
    constant = F.coalesce("distinct", F.lit(0)) <= 1
    rare = (F.col("top") / F.col("second") > freq_cut) & (distinct_pct <= unique_cut)
    return stats.select("column", "top", "second", F.coalesce("distinct", F.lit(0)).alias("distinct"),
                        (constant | F.coalesce(rare, F.lit(False))).alias("drop"))


def near_zero_var_cols(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> list[str]:
    """Names to drop, by the exact counts."""
    fitted = {r["column"] for r in fit_near_zero_var(df, freq_cut, unique_cut).filter("drop").collect()}
    return [c for c in df.columns if c in fitted]


def drop_near_zero_var(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    return drop_cols(df, near_zero_var_cols(df, freq_cut, unique_cut))


def drop_common_nzv(frames: Sequence[DataFrame], keep: Sequence[str] = ()) -> list[DataFrame]:
    """Drop from every table what is near-constant in all of them, except the columns to keep."""
    lists = [set(near_zero_var_cols(f)) for f in frames]
    gone = set.intersection(*lists) - set(keep)
    return [drop_cols(f, list(gone)) for f in frames]


def _comparable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(quoted(name)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else quoted(name)


def _text(df: DataFrame, name: str) -> Column:
    return _comparable(df, name).cast("string")
