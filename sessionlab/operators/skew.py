"""Work that would put one whole key in one task, cut into bounded pieces.

A window sends every row of its partition key to one task, and no runtime setting splits it. Where a key is
too big for that, the helpers here sort all rows once by key and order, run the window in blocks of bounded
size, and hand over what crosses a block's edge in a small table. Results are exact either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlab.operators.cleaning import quoted
from sessionlab.session import cut_lineage

HOT_ROWS_CONF = "sessionlab.skew.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
BROADCAST_ROWS = 100_000
SKETCH_ACCURACY = 10_000


def hot_rows_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def _too_big(df: DataFrame, key: str, limit: int) -> bool:
    """Whether a key has more rows than one task should hold: one narrow, map-side combined count."""
    sizes = df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("_n"))
    return (sizes.agg(F.max("_n")).first()[0] or 0) > limit


def in_order(df: DataFrame, key: str, order: str, tie: Sequence[str], block: int) -> DataFrame:
    """The rows, stored, with ``_at``: their number in the order of key, order column and ties, without gaps, and
    ``_block``: that number by ``block`` rows.

    One range sort, in which a row's own id comes last: rows that are equal in all sort columns are spread like others, and
    a key of any size is as good as many small ones. The sizes of the tasks are the only thing handed over.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    ordered = rows.orderBy(*[quoted(c) for c in (key, order, *tie)], "_id").drop("_id")
    placed = cut_lineage(ordered.withColumn("_in", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_in", 33))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    before = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_c")).select(
        "_task", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_in") - F.shiftleft(F.col("_task"), 33)
    numbered = placed.join(F.broadcast(before), "_task").withColumn("_at", at).drop("_task", "_before", "_in")
    return numbered.withColumn("_block", F.expr(f"_at div {block}"))


def neighbours_in_order(df: DataFrame, key: str, order: str, tie: Sequence[str], n_prev: int, n_next: int,
                        hot_rows: int | None = None) -> DataFrame:
    """Adds ``prev_1..prev_n`` and ``next_1..next_n``: the order value of the k-th row before / after the row within its key.

    A plain window while every key fits a task. Otherwise the rows are sorted once and cut into blocks of at most the limit,
    whatever keys they hold; a block's window is complete but at its edges, for which the few rows next to it are handed over.
    """
    limit = max(hot_rows or hot_rows_limit(df), n_prev, n_next, 1)
    k, o = quoted(key), quoted(order)
    if not _too_big(df, key, limit):
        w = Window.partitionBy(k).orderBy(o, *[quoted(t) for t in tie])
        return df.withColumns({f"prev_{i}": F.lag(o, i).over(w) for i in range(1, n_prev + 1)}
                              | {f"next_{i}": F.lead(o, i).over(w) for i in range(1, n_next + 1)})
    sorted_rows = in_order(df, key, order, tie, limit)
    cell = F.struct(F.col("_at").alias("at"), k.alias("key"), o.alias("value"))
    place = F.pmod("_at", F.lit(limit))
    tails = _edge(sorted_rows.filter(place >= limit - n_prev), F.col("_block") + 1, cell, "_tail") if n_prev else None
    heads = _edge(sorted_rows.filter(place < n_next), F.col("_block") - 1, cell, "_head") if n_next else None
    w = Window.partitionBy("_block").orderBy("_at")
    out = sorted_rows.withColumns({f"_lag_{i}": F.lag(cell, i).over(w) for i in range(1, n_prev + 1)}
                                  | {f"_lead_{i}": F.lead(cell, i).over(w) for i in range(1, n_next + 1)})
    for edge in (e for e in (tails, heads) if e is not None):
        out = out.join(edge, "_block", "left")
    found = {}
    for i in range(1, n_prev + 1):  # the tail's last row comes right before the block
        found[f"prev_{i}"] = F.coalesce(F.col(f"_lag_{i}"), F.get(F.reverse("_tail"), (F.lit(i) - 1 - place).cast("int")))
    for i in range(1, n_next + 1):
        found[f"next_{i}"] = F.coalesce(F.col(f"_lead_{i}"), F.get("_head", (place + i - limit).cast("int")))
    return out.select(*[quoted(c) for c in df.columns],
                      *[F.when(c["key"].eqNullSafe(k), c["value"]).alias(name) for name, c in found.items()])


def _edge(rows: DataFrame, block: Column, cell: Column, name: str) -> DataFrame:
    """Per block, the few rows next to it in a neighbouring block, in order."""
    return rows.groupBy(block.alias("_block")).agg(F.sort_array(F.collect_list(cell)).alias(name))


def number_in_order(df: DataFrame, key: str, order: str, tie: Sequence[str], name: str,
                    hot_rows: int | None = None) -> DataFrame:
    """Row number within the key. Where a key is too big for a task: the place in the sorted rows, less that of the key's
    first row. Only a key that goes on from an earlier block needs a start handed over, one per block at most."""
    limit = hot_rows or hot_rows_limit(df)
    k = quoted(key)
    if not _too_big(df, key, limit):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(k).orderBy(*[quoted(c) for c in (order, *tie)])))
    sorted_rows = in_order(df, key, order, tie, limit)
    pieces = sorted_rows.groupBy("_block", k.alias("_key")).agg(F.min("_at").alias("_own"))
    start = F.min("_own").over(Window.partitionBy("_key"))
    going_on = pieces.withColumn("_start", start).filter("_start < _own").select(F.col("_block").alias("_b"), "_key", "_start")
    own = F.min("_at").over(Window.partitionBy("_block", k))
    out = sorted_rows.withColumn("_own", own).join(
        going_on, (F.col("_block") == F.col("_b")) & k.eqNullSafe(F.col("_key")), "left")
    number = (F.col("_at") - F.coalesce("_start", "_own") + 1).cast("int")
    return out.select(*[quoted(c) for c in df.columns], number.alias(name))


# Up to this many distinct values a quantile may use one counter per value inside an aggregation.
COUNTER_VALUES = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], probabilities: Sequence[float],
                    counters: int = COUNTER_VALUES) -> DataFrame:
    """Exact interpolated quantiles per group, however large the group and however many its values: ``<value>_<i>`` for the
    i-th probability. All values and probabilities share the scans.

    The quantile itself is always the built-in ``percentile``, which keeps one counter for each value. Where a group has too
    many values, they are first held to a bracket [low, high] around the quantile: what lies outside counts at the
    bracket's ends, which moves no order statistic inside. A sketch with a guaranteed rank error gives the first bracket;
    as long as a bracket holds too many values it is cut into 100 parts, and those with the quantile's neighbours are the next one.
    Every step is an aggregate with partial results in the map tasks; no group's rows are ever ordered in a task.
    """
    keys, values = list(keys), list(values)
    names = [(v, i, p) for v in range(len(values)) for i, p in enumerate(probabilities)]
    rows = df.select(*[quoted(k).alias(f"_k{j}") for j, k in enumerate(keys)],
                     *[quoted(v).cast("double").alias(f"_v{j}") for j, v in enumerate(values)])
    group = [F.col(f"_k{j}") for j in range(len(keys))]
    seen = rows.groupBy(*group).agg(*[F.approx_count_distinct(f"_v{j}").alias(f"_d{j}") for j in range(len(values))])
    most = seen.agg(*[F.max(f"_d{j}") for j in range(len(values))]).first()
    wide = [n for n in names if (most[n[0]] or 0) > counters]
    clamped = {n: F.col(f"_v{n[0]}") for n in names}
    if wide:
        rows = _bracketed(rows, len(keys), wide, counters)
        for v, i, _ in wide:
            clamped[v, i, _] = F.least(F.greatest(F.col(f"_v{v}"), F.col(f"_lo{v}_{i}")), F.col(f"_hi{v}_{i}"))
    # least and greatest skip NULL, a missing value stays missing
    found = rows.groupBy(*group).agg(*[
        F.percentile(F.when(F.col(f"_v{n[0]}").isNotNull(), c), F.lit(float(n[2]))).alias(f"_q{n[0]}_{n[1]}") for n, c in clamped.items()])
    return found.select(*[g.alias(k) for g, k in zip(group, keys)], *[F.col(f"_q{v}_{i}").alias(f"{values[v]}_{i}") for v, i, _ in names])


def _bracketed(rows: DataFrame, n_keys: int, wanted: Sequence[tuple[int, int, float]], counters: int, parts: int = 100) -> DataFrame:
    """The rows with brackets ``_lo`` and ``_hi`` per value and probability of the row's group, which hold few values."""
    group = [f"_k{j}" for j in range(n_keys)]
    margin = 3.0 / SKETCH_ACCURACY

    def ends(v: int, p: float) -> Column:
        return F.percentile_approx(f"_v{v}", [max(0.0, p - margin), min(1.0, p + margin)], SKETCH_ACCURACY)

    def end(v: int, p: float, k: int) -> Column:  # in a small group the margin is less than a row: take all of it
        whole = (F.min if k == 0 else F.max)(f"_v{v}")
        return F.when(F.count(f"_v{v}") <= 10 * SKETCH_ACCURACY, whole).otherwise(F.get(ends(v, p), F.lit(k)))
    brackets = rows.groupBy(*group).agg(
        *[F.count(f"_v{v}").alias(f"_n{v}") for v in sorted({v for v, _, _ in wanted})],
        *[end(v, p, k).alias(f"_{side}{v}_{i}") for v, i, p in wanted for k, side in ((0, "lo"), (1, "hi"))])
    while True:
        brackets = cut_lineage(brackets)
        joined = _on_group(rows, brackets, group)
        inside = {(v, i): (F.col(f"_v{v}") >= F.col(f"_lo{v}_{i}")) & (F.col(f"_v{v}") <= F.col(f"_hi{v}_{i}")) for v, i, _ in wanted}
        sizes = joined.groupBy(*group).agg(*[F.approx_count_distinct(F.when(c, F.col(f"_v{v}"))).alias(f"_s{v}_{i}") for (v, i), c in inside.items()])
        largest = sizes.agg(*[F.max(f"_s{v}_{i}") for v, i in inside]).first()
        if all((n or 0) <= counters for n in largest):
            return joined
        for (v, i, p), n in zip(wanted, largest):
            if (n or 0) > counters:
                brackets = _narrowed(joined, brackets, group, v, i, p, parts)


def _narrowed(joined: DataFrame, brackets: DataFrame, group: list[str], v: int, i: int, p: float, parts: int) -> DataFrame:
    """The brackets, with that of one value and probability cut to the parts that hold the quantile's two neighbours.

    Cuts come from a sketch of what the bracket holds, so that the parts hold about as many rows each, however the values
    are spread; what is counted between them is exact."""
    value, low, high = F.col(f"_v{v}"), F.col(f"_lo{v}_{i}"), F.col(f"_hi{v}_{i}")
    inside = F.when((value >= low) & (value <= high), value)
    steps = [k / parts for k in range(1, parts)]
    cuts = joined.groupBy(*group).agg(F.percentile_approx(inside, steps, SKETCH_ACCURACY).alias("_cuts"))
    met = _on_group(joined, cuts, group)
    part = F.when(value < low, -1).when(value > high, parts).otherwise(F.size(F.filter("_cuts", lambda c: c < value)))
    counted = met.filter(value.isNotNull()).groupBy(*group, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.first(f"_n{v}").alias("_n"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part"))  # at most parts + 2 rows per group
    rank = F.lit(float(p)) * (F.col("_n") - 1)
    holds = (F.col("_upto") > F.floor(rank)) & (F.col("_upto") - F.col("_c") <= F.ceil(rank))
    cut = counted.withColumn("_upto", upto).filter(holds).groupBy(*group).agg(F.min("_least").alias("_l"), F.max("_most").alias("_h"))
    return _on_group(brackets, cut, group).withColumns(
        {f"_lo{v}_{i}": F.coalesce("_l", low), f"_hi{v}_{i}": F.coalesce("_h", high)}).drop("_l", "_h")


def _on_group(df: DataFrame, side: DataFrame, group: list[str]) -> DataFrame:
    """Left join on the group columns, NULL matching NULL; without any, the side's one row as literals."""
    if not group:
        row = side.first()
        return df.withColumns({c: F.lit(row[c]).cast(t) for c, t in side.dtypes})
    side = side.withColumnsRenamed({g: f"_b{g}" for g in group})
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_b{g}")) for g in group])
    return df.join(side, same, "left").drop(*[f"_b{g}" for g in group])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile",
                   counters: int = COUNTER_VALUES) -> DataFrame:
    """One exact quantile per group; see ``exact_quantiles``. Groups without a value have none."""
    present = df.filter(quoted(value).isNotNull())
    found = exact_quantiles(present, keys, [value], [p], counters)
    return found.select(*[quoted(k) for k in keys], quoted(f"{value}_0").alias(name))


def global_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles of a whole column, as numbers (a fit step)."""
    found = list(exact_quantiles(df, [], [column], probabilities).first())
    return [] if any(q is None for q in found) else found


def dense_codes(df: DataFrame, group: str, value: str) -> DataFrame:
    """1-based rank of each distinct value within its group, in value order, as ``code``.

    A global range sort spreads the values over tasks; the position inside a task plus the sizes of the
    tasks before it give the rank. No task sees more than its share, whatever the group sizes.
    """
    ordered = df.select(group, value).distinct().orderBy(group, value)
    # The id is (task number << 33) + position in the task; the checkpoint fixes it once for both uses.
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    tasks = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_c"))  # one row per task
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("_task", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    indexed = placed.withColumn("_task", task).join(F.broadcast(offsets), "_task").select(
        group, value, (F.col("_offset") + F.col("_at") - F.shiftleft(F.col("_task"), 33)).alias("_index"))
    start = indexed.groupBy(F.col(group).alias("_g")).agg(F.min("_index").alias("_start"))
    # One row per group, and the groups are columns of a table: a known bound.
    return indexed.join(F.broadcast(start), F.col(group).eqNullSafe(F.col("_g"))).select(
        group, value, (F.col("_index") - F.col("_start") + 1).cast("int").alias("code"))
