"""Train / validation splits as columns. Hash-based, so they do not depend on partitioning or re-runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlab.operators.cleaning import quoted
from sessionlab.operators.skew import global_quantiles
from sessionlab.operators.windows import day_ordinal


def holdout_by_date(df: DataFrame, day: str, first_validation_day: str, name: str = "is_val") -> DataFrame:
    return df.withColumn(name, quoted(day) >= F.lit(first_validation_day).cast("date"))


def group_kfold(df: DataFrame, key: str, v: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold 0 .. v-1 from a hash of the key: all rows of a visitor share a fold, with no shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(quoted(key), F.lit(seed)), F.lit(v)).cast("int"))


def portable_hash(key: str, digits: int = 8) -> Column:
    """Leading hex digits of md5(text of the key) as a number; the same in any engine."""
    return F.conv(F.substring(F.md5(quoted(key).cast("string")), 1, digits), 16, 10).cast("long")


def group_kfold_portable(df: DataFrame, key: str, v: int = 5, name: str = "fold") -> DataFrame:
    return df.withColumn(name, (portable_hash(key) % v).cast("int"))


@dataclass(frozen=True)
class StratifiedSplit:
    """Inner label breaks, and per label bucket the largest hash that still belongs to the training part."""

    label: str
    row_id: str
    breaks: tuple[float, ...]
    limits: dict[int, int]


def _bucket(label: str, breaks: Sequence[float]) -> Column:
    """0-based bucket of right-closed intervals: the number of breaks below the label."""
    bucket = F.lit(0)
    for b in breaks:
        bucket = bucket + (quoted(label) > F.lit(float(b))).cast("int")
    return bucket


def fit_stratified_split(df: DataFrame, label: str, row_id: str, p: float = 0.75, points: int = 5) -> StratifiedSplit:
    """Label buckets between ``points`` equally spaced quantiles, then the ceil(p * n) smallest hashes of
    each bucket. The cut is an exact order statistic of the hash, found without ranking a bucket in one
    task, so a bucket may hold nearly all rows (a zero-inflated label)."""
    values = sorted(set(global_quantiles(df, label, [i / (points - 1) for i in range(points)])))
    breaks = tuple(values[1:-1])
    # 15 hex digits: 60 bits, exact in a long and below any collision that would matter for a split.
    hashed = df.filter(quoted(label).isNotNull()).select(
        _bucket(label, breaks).alias("_bucket"), portable_hash(row_id, 15).alias("_h"))
    return StratifiedSplit(label, row_id, breaks, _kth_smallest(hashed, p))


def _kth_smallest(hashed: DataFrame, p: float, bits: int = 60, step: int = 12, few: int = 10_000) -> dict[int, int]:
    """Per bucket (a handful), the ceil(p * n)-th smallest hash, by narrowing the hash range 4096-fold per
    pass. A pass is one aggregate of at most 4096 counters per bucket; once at most ``few`` hashes are left
    in a bucket's range they are read and the rank is taken directly."""
    sizes = {r["_bucket"]: r["n"] for r in hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {b: _ceil_share(n, p) for b, n in sizes.items()}
    prefix = {b: 0 for b in sizes}
    shift = bits
    while True:
        inside = F.lit(False)
        for b, high in prefix.items():
            inside = inside | ((F.col("_bucket") == b) & (F.shiftright("_h", shift) == F.lit(high)))
        rows = hashed.filter(inside)
        if shift == 0 or max(sizes.values(), default=0) <= few:
            found = rows.select("_bucket", "_h").distinct() if shift == 0 else rows
            left: dict[int, list[int]] = {b: [] for b in sizes}
            for r in found.collect():
                left[r["_bucket"]].append(r["_h"])
            return {b: sorted(v)[0 if shift == 0 else rank[b] - 1] for b, v in left.items()}
        width = min(step, shift)
        digit = F.shiftright("_h", shift - width).bitwiseAND(F.lit((1 << width) - 1))
        counts = rows.groupBy("_bucket", digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b in prefix:
            for d, n in sorted((r["d"], r["n"]) for r in counts if r["_bucket"] == b):
                if rank[b] <= n:
                    prefix[b], sizes[b] = (prefix[b] << width) | d, n
                    break
                rank[b] -= n
        shift -= width


def _ceil_share(n: int, p: float) -> int:
    share = n * p
    return int(share) if share == int(share) else int(share) + 1


def apply_stratified_split(df: DataFrame, split: StratifiedSplit, name: str = "is_train") -> DataFrame:
    """A pure projection: no shuffle."""
    limit = F.lit(None).cast("long")
    bucket = _bucket(split.label, split.breaks)
    for b, h in split.limits.items():
        limit = F.when(bucket == b, F.lit(h)).otherwise(limit)
    return df.withColumn(name, F.coalesce(portable_hash(split.row_id, 15) <= limit, F.lit(False)))


# Last training day and first / last validation day of the five expanding folds.
EXPANDING_FOLDS = (
    (107, 122, 171),
    (155, 173, 220),
    (207, 222, 269),
    (256, 271, 320),
    (307, 322, 366),
)


def expanding_time_folds(df: DataFrame, day: str, folds: Sequence[tuple[int, int, int]] = EXPANDING_FOLDS) -> DataFrame:
    """Per fold i, ``role_i`` is train, valid or NULL (the gap and what lies outside)."""
    numbered = day_ordinal(df, day)
    roles = {}
    for i, (last_train, first_val, last_val) in enumerate(folds, 1):
        n = F.col("day_no")
        roles[f"role_{i}"] = F.when(n <= last_train, "train").when(n.between(first_val, last_val), "valid")
    return numbered.withColumns(roles)


def leave_month_out(df: DataFrame, day: str, name: str = "fold_month") -> DataFrame:
    """The month a row validates in; it trains every other month's model. Half-open, one fold per month."""
    return df.withColumn(name, F.trunc(quoted(day), "month"))
