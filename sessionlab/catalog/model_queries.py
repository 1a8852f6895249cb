"""Queries on splits, matrices, learners and scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionlab.catalog.aggregate_queries import rounded
from sessionlab.catalog.inputs import S, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.operators import modelling as M
from sessionlab.operators import scoring as Sc
from sessionlab.operators import splits as P
from sessionlab.session import scratch_path
from sessionlab.sources.readers import scan_typed_csv
from sessionlab.sources.schemas import struct

_MD5_FOLD = "CAST(CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % {} AS INTEGER)"


@query("holdout_by_date", "SELECT event_id, ts >= TIMESTAMP '2024-01-20' AS is_val FROM events")
def holdout_by_date(spark, d):
    return P.holdout_by_date(table(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-20").drop("ts")


@query("group_kfold", f"SELECT event_id, user_id, {_MD5_FOLD.format('user_id', 5)} AS fold FROM events")
def group_kfold(spark, d):
    return P.group_kfold_portable(table(spark, d, "events").select("event_id", "user_id"), "user_id", 5)


@query("group_kfold_xxhash", """
SELECT count(DISTINCT user_id) AS users, count(*) AS n, CAST(1 AS BIGINT) AS folds_per_user FROM events""")
def group_kfold_xxhash(spark, d):
    """Every visitor lies in exactly one fold."""
    folds = P.group_kfold(table(spark, d, "events").select("user_id"), "user_id", 5)
    per_user = folds.groupBy("user_id").agg(F.count_distinct("fold").alias("f"), F.count(F.lit(1)).alias("c"))
    return per_user.agg(F.count(F.lit(1)).alias("users"), F.sum("c").alias("n"), F.max("f").alias("folds_per_user"))


@query("stratified_split", """
WITH y AS (SELECT event_id, ln(1 + value) AS y, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM events),
q AS (SELECT unnest(quantile_cont(y, [0.25, 0.5, 0.75])) AS b FROM y),
k AS (SELECT event_id, h, (SELECT count(*) FROM q WHERE y.y > q.b) AS bucket FROM y),
r AS (SELECT event_id, row_number() OVER (PARTITION BY bucket ORDER BY h, event_id) AS n,
             count(*) OVER (PARTITION BY bucket) AS total FROM k)
SELECT event_id, n <= ceil(total * 0.75) AS is_train FROM r""")
def stratified_split(spark, d):
    rows = table(spark, d, "events").select("event_id", F.log1p("value").alias("y"))
    return P.apply_stratified_split(rows, P.fit_stratified_split(rows, "y", "event_id", 0.75)).drop("y")


@query("stratified_split_zero_inflated", f"""
WITH {S}, y AS (SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM s),
r AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id) AS n, count(*) OVER () AS total FROM y)
SELECT event_id, n <= ceil(total * 0.75) AS is_train FROM r""")
def stratified_split_zero_inflated(spark, d):
    """Most labels are zero, so all inner quantiles coincide and one bucket holds every row."""
    rows = sessions(spark, d).select("event_id", F.coalesce("revenue", F.lit(0.0)).alias("y"))
    return P.apply_stratified_split(rows, P.fit_stratified_split(rows, "y", "event_id", 0.75)).drop("y")


@query("expanding_time_folds", """
WITH r AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS n FROM orders)
SELECT o_orderkey, """ + ", ".join(
    f"CASE WHEN n <= {t} THEN 'train' WHEN n BETWEEN {a} AND {b} THEN 'valid' END AS role_{i}"
    for i, (t, a, b) in enumerate(P.EXPANDING_FOLDS, 1)) + " FROM r")
def expanding_time_folds(spark, d):
    out = P.expanding_time_folds(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.select("o_orderkey", *[f"role_{i}" for i in range(1, 6)])


@query("leave_month_out", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS fold_month FROM orders")
def leave_month_out(spark, d):
    return P.leave_month_out(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("index_setdiff", f"""
SELECT event_id, user_id FROM events WHERE NOT {_MD5_FOLD.format('user_id', 5)} = 2""")
def index_setdiff(spark, d):
    """The rows outside one fold, by the fold column."""
    folds = P.group_kfold_portable(table(spark, d, "events").select("event_id", "user_id"), "user_id", 5)
    return folds.filter(F.col("fold") != 2).drop("fold")


# --- matrix and learners ------------------------------------------------------------------------------------


@query("assemble", f"""
WITH {S} SELECT event_id, CASE WHEN revenue IS NULL THEN -999.0 ELSE revenue END AS f0, CAST(k AS DOUBLE) AS f1,
  CAST(hour(ts) AS DOUBLE) AS f2, round(ln(1 + value), 6) AS y FROM s""")
def assemble(spark, d):
    """Vector column read back as plain columns."""
    rows = sessions(spark, d).withColumns({"hour": F.hour("ts"), "y": F.log1p("value")})
    matrix = M.assemble(rows, ["revenue", "k", "hour"], "y", keep=["event_id"]).withColumn("a", vector_to_array("features"))
    return matrix.select("event_id", *[F.get("a", F.lit(i)).alias(f"f{i}") for i in range(3)], F.round("y", 6).alias("y"))


# One tree of depth 1 without sampling, on a column of two values: a prediction is the mean label of the training rows in
# the same half, which SQL can say for every row.
STUMP = M.BoostSettings(max_iter=1, depth=1, step=1.0, subsample=1.0, min_rows=1)
STUMP_FEATURES = ["half", "same", "also_same"]
_LINES = f"""lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, {_MD5_FOLD.format('l_orderkey', 3)} AS fold, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS half,
         ln(1 + l_quantity * (1 + l_discount * 10)) AS y FROM lineitem),
sums AS (SELECT fold, half, sum(y) AS s, count(*) AS n FROM lines GROUP BY ALL),
fits AS (SELECT f.fold, g.half, sum(CASE WHEN g.fold <> f.fold THEN g.s END) / sum(CASE WHEN g.fold <> f.fold THEN g.n END) AS pred
         FROM (SELECT DISTINCT fold FROM lines) f, sums g GROUP BY ALL)"""


def _halves(spark, d):
    """Line items with a column of two values and two constant ones; a fold by order."""
    items = table(spark, d, "lineitem").withColumns({
        "half": (F.col("l_quantity") > 25).cast("int"), "same": F.lit(1), "also_same": F.lit(2),
        "y": F.log1p(F.col("l_quantity") * (1 + F.col("l_discount") * 10))})
    rows = P.group_kfold_portable(items, "l_orderkey", 3).withColumn("is_val", F.col("fold") == 0)
    return M.assemble(rows, STUMP_FEATURES, "y", keep=["l_orderkey", "l_linenumber", "l_quantity", "fold", "is_val"])


def _predicted(df, column):
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round(column, 6).alias("pred"))


@query("fit_boosted", f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, l_quantity, round(pred, 6) AS pred
FROM lines JOIN fits ON fits.half = lines.half AND fits.fold = 0""")
def fit_boosted(spark, d):
    """Trained on the rows that are not for validation; every row is predicted."""
    matrix = _halves(spark, d)
    return _predicted(M.fit_boosted(matrix, "y", "is_val", STUMP).transform(matrix), "prediction")


@query("refit_scaled_rounds", f"""
WITH {_LINES}, rounds AS (SELECT CAST(round(1 + avg(CASE WHEN fold = 0 THEN 1 ELSE 0 END)) AS INTEGER) AS r FROM lines),
whole AS (SELECT half, avg(y) AS pred FROM lines GROUP BY half)
SELECT l_orderkey, l_linenumber, l_quantity, round(pred, 6) AS pred, r AS rounds FROM lines JOIN whole USING (half), rounds""")
def refit_scaled_rounds(spark, d):
    """Rounds scaled by the share of validation rows; the refit learns from all rows."""
    matrix = _halves(spark, d)
    model, rounds = M.refit_scaled_rounds(matrix, "y", "is_val", STUMP)
    return _predicted(model.transform(matrix), "prediction").withColumn("rounds", F.lit(rounds))


@query("oof_predict", f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, l_quantity, lines.fold, round(pred, 6) AS pred
FROM lines JOIN fits ON fits.half = lines.half AND fits.fold = lines.fold""")
def oof_predict(spark, d):
    """Every row, repeated ones too, is predicted by the model that did not train on its fold."""
    out = M.oof_predict(_halves(spark, d), "y", M.k_folds("fold", 3), settings=STUMP)
    return out.train.select("l_orderkey", "l_linenumber", "l_quantity", "fold", F.round("pred", 6).alias("pred"))


@query("fold_average", f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, l_quantity, round(p, 6) AS pred
FROM lines JOIN (SELECT half, avg(pred) AS p FROM fits GROUP BY half) USING (half)""")
def fold_average(spark, d):
    """Test rows get the mean of the fold models; no row is merged."""
    matrix = _halves(spark, d)
    return _predicted(M.oof_predict(matrix, "y", M.k_folds("fold", 3), test=matrix.drop("y", "fold"), settings=STUMP).test, "pred")


@query("oof_expanding", f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, l_quantity, lines.fold, round(pred, 6) AS pred
FROM lines LEFT JOIN (
  SELECT 1 AS fold, half, avg(y) AS pred FROM lines WHERE fold = 0 GROUP BY half
  UNION ALL SELECT 2, half, avg(y) FROM lines WHERE fold < 2 GROUP BY half) e ON e.fold = lines.fold AND e.half = lines.half""")
def oof_expanding(spark, d):
    """Expanding windows: each part is predicted from those before it, the first from none."""
    folds = [(F.col("fold") < i, F.col("fold") == i) for i in (1, 2)]
    out = M.oof_predict(_halves(spark, d), "y", folds, settings=STUMP)
    return out.train.select("l_orderkey", "l_linenumber", "l_quantity", "fold", F.round("pred", 6).alias("pred"))


@query("oof_leave_month_out", """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, month(l_shipdate) AS m, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS half,
         ln(1 + l_quantity * (1 + l_discount * 10)) AS y FROM lineitem),
sums AS (SELECT m, half, sum(y) AS s, count(*) AS n FROM lines GROUP BY ALL),
fits AS (SELECT f.m AS m, g.half AS half, sum(CASE WHEN g.m <> f.m THEN g.s END) / sum(CASE WHEN g.m <> f.m THEN g.n END) AS pred
         FROM (SELECT DISTINCT m FROM lines) f, sums g GROUP BY ALL)
SELECT l_orderkey, l_linenumber, FALSE AS by_all, round(fits.pred, 6) AS pred
FROM lines JOIN fits ON fits.half = lines.half AND fits.m = lines.m
UNION ALL SELECT l_orderkey, l_linenumber, TRUE, round(every.pred, 6)
FROM lines JOIN (SELECT half, avg(pred) AS pred FROM fits GROUP BY half) every ON every.half = lines.half""")
def oof_leave_month_out(spark, d):
    """Twelve models: each row by the model that did not train on its month, and by the mean of all models."""
    items = table(spark, d, "lineitem").withColumns({
        "half": (F.col("l_quantity") > 25).cast("int"), "same": F.lit(1), "also_same": F.lit(2), "m": F.month("l_shipdate"),
        "y": F.log1p(F.col("l_quantity") * (1 + F.col("l_discount") * 10))})
    matrix = M.assemble(items, STUMP_FEATURES, "y", keep=["l_orderkey", "l_linenumber", "m"])
    out = M.oof_predict(matrix, "y", M.month_conditions(matrix, "m"), test=matrix.drop("y", "m"), settings=STUMP)
    own, every = (df.select("l_orderkey", "l_linenumber", F.lit(name).alias("by_all"), F.round("pred", 6).alias("pred"))
                  for df, name in ((out.train, False), (out.test, True)))
    return own.unionByName(every)


@query("feature_importance", f"""
WITH {_LINES} SELECT 'half' AS feature, CASE WHEN count(DISTINCT half) = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS gain FROM lines
UNION ALL SELECT 'same', 0.0 UNION ALL SELECT 'also_same', 0.0""")
def feature_importance(spark, d):
    """Only one column carries a signal, so all gain is its."""
    model = M.fit_boosted(_halves(spark, d), "y", "is_val", STUMP)
    return M.feature_importance(model, STUMP_FEATURES, spark)


_PCA = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("pca", """
SELECT l_orderkey, l_linenumber, l_partkey, round(""" + " + ".join(
    f"power(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 2)" for c in _PCA) + """, 5) AS norm2
FROM lineitem""")
def pca(spark, d):
    """With all components kept, a row's squared length equals that of its standardised values: the check is
    free of the components' signs."""
    items = table(spark, d, "lineitem")
    rows = items.select("l_orderkey", "l_partkey", *_PCA)
    model = M.fit_pca(rows, list(_PCA), 4)
    scored = M.apply_pca(rows, list(_PCA), model)
    length = sum((F.pow(F.col(f"PC{i}"), F.lit(2.0)) for i in range(1, 5)), F.lit(0.0))
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round(length, 5).alias("norm2"))


@query("pca_explained_variance", """
SELECT 'PC1' AS component, round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 5) AS share FROM lineitem
UNION ALL SELECT 'PC2', round((1 - abs(corr(l_quantity, l_extendedprice))) / 2, 5) FROM lineitem""")
def pca_explained_variance(spark, d):
    """Two standardised columns: the shares are (1 +- |r|) / 2."""
    columns = ["l_quantity", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select(*columns)
    scored = M.apply_pca(rows, columns, M.fit_pca(rows, columns, 2))
    shares = scored.agg((F.var_samp("PC1") / 2).alias("PC1"), (F.var_samp("PC2") / 2).alias("PC2"))
    return rounded(shares.unpivot([], ["PC1", "PC2"], "component", "share"), "share")


# --- scoring ------------------------------------------------------------------------------------------------

@query("stack_to_visitor", f"""
WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS n FROM s),
a AS (SELECT user_id, round(avg(k), 8) AS k, round(avg(hour(ts)), 8) AS hour,
  round(ln(1 + sum(exp(ln(1 + coalesce(revenue, 0))) - 1)), 5) AS y FROM s GROUP BY user_id),
p AS (SELECT user_id, {', '.join(f'max(CASE WHEN n = {i} THEN value END) AS pred{i}' for i in range(1, 31))},
  round(avg(value), 8) AS p_mean, round(median(value), 5) AS p_med, round(stddev_samp(value), 5) AS p_sd,
  round(sum(value), 5) AS p_sum, min(value) AS p_min, max(value) AS p_max FROM r WHERE n <= 30 GROUP BY user_id)
SELECT * FROM a JOIN p USING (user_id)""")
def stack_to_visitor(spark, d):
    rows = sessions(spark, d).withColumns({
        "hour": F.hour("ts"), "pred": F.col("value"), "y": F.log1p(F.coalesce("revenue", F.lit(0.0)))})
    out = Sc.stack_to_visitor(rows, "user_id", "start", ["event_id"], ["k", "hour"], "pred", "y")
    return out.withColumns({"k": F.round("k", 8), "hour": F.round("hour", 8), "y": F.round("y", 5)}).withColumns(
        {"p_mean": F.round("p_mean", 8)} | {c: F.round(c, 5) for c in ("p_med", "p_sd", "p_sum")})


@query("session_to_visitor_score", f"""
WITH {S} SELECT user_id, round(ln(1 + sum(CASE WHEN value - 20 < 0 THEN 0 ELSE value - 20 END)), 5) AS y FROM s GROUP BY user_id""")
def session_to_visitor_score(spark, d):
    rows = sessions(spark, d).select("user_id", (F.col("value") - 20).alias("pred"))
    return rounded(Sc.session_to_visitor_score(rows, "user_id", "pred", log_scale=False), "y")


@query("average_models", f"""
WITH {S} SELECT event_id, round((value + value * 2 + k) / 3, 8) AS pred FROM s""")
def average_models(spark, d):
    rows = sessions(spark, d)
    frames = [rows.select("event_id", e.cast("double").alias("pred")) for e in (F.col("value"), F.col("value") * 2, F.col("k"))]
    return rounded(Sc.average_models(frames, "event_id", "pred"), "pred", digits=8)


@query("write_result", f"""
WITH {S}, p AS (SELECT CAST(user_id AS VARCHAR) AS v, ln(1 + sum(coalesce(revenue, 0))) AS y FROM s GROUP BY user_id)
SELECT CAST(c_custkey AS VARCHAR) AS "fullVisitorId", round_even(y, 5) AS "PredictedLogRevenue"
FROM customer LEFT JOIN p ON CAST(c_custkey AS VARCHAR) = v""")
def write_result(spark, d):
    """Result file for every visitor of the template, written and read back."""
    rows = sessions(spark, d).groupBy(F.col("user_id").cast("string").alias("fullVisitorId")).agg(
        F.log1p(F.sum(F.coalesce("revenue", F.lit(0.0)))).alias("y"))
    template = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("fullVisitorId"))
    path = Sc.write_result(rows, template, "fullVisitorId", "y", scratch_path(spark, "result"), "visitors", 0.14066)
    return scan_typed_csv(spark, path, struct(fullVisitorId="string", PredictedLogRevenue="double"))
