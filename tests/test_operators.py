"""Operators on hand-made frames: NULL groups, single rows, quirks, skewed keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from sessionlab.catalog import scalar_queries
from sessionlab.operators import aggregates as A
from sessionlab.operators import cleaning as K
from sessionlab.operators import encoding as E
from sessionlab.operators import joins as J
from sessionlab.operators import modelling as M
from sessionlab.operators import profiling as P
from sessionlab.operators import scoring as S
from sessionlab.operators import skew
from sessionlab.operators import splits as L
from sessionlab.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """One visitor with two thirds of the rows, tied start times, a NULL visitor."""
    rng = random.Random(5)
    data = [("hot", rng.randrange(400), i) for i in range(600)]
    data += [(f"v{i % 37}", rng.randrange(400), 1000 + i) for i in range(250)]
    data += [(None, rng.randrange(50), 2000 + i) for i in range(50)]
    return spark.createDataFrame(data, "visitor string, start long, id long").repartition(4).cache()


@pytest.mark.parametrize("limit", [3, 10, 60, 100_000])
def test_neighbours_across_blocks_equal_plain_window(skewed, limit):
    got = skew.neighbours_in_order(skewed, "visitor", "start", ["id"], 3, 3, limit)
    w = Window.partitionBy("visitor").orderBy("start", "id")
    want = skewed.withColumns({f"prev_{k}": F.lag("start", k).over(w) for k in (1, 2, 3)}
                              | {f"next_{k}": F.lead("start", k).over(w) for k in (1, 2, 3)})
    assert rows(got.select(*want.columns)) == rows(want)


@pytest.mark.parametrize("limit", [1, 10, 60, 100_000])
def test_row_number_across_blocks_equals_plain_window(skewed, limit):
    got = skew.number_in_order(skewed, "visitor", "start", ["id"], "n", limit)
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("visitor").orderBy("start", "id")))
    assert rows(got) == rows(want)


def test_tied_rows_are_cut_into_blocks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k.x"), F.lit(7).alias("t.y"), F.lit("same").alias("z"))
    sizes = [r["count"] for r in skew.in_order(df, "k.x", "t.y", ["z"], 500).groupBy("_block").count().collect()]
    assert max(sizes) == 500 and sum(sizes) == 20_000
    got = skew.number_in_order(df, "k.x", "t.y", ["z"], "n", 500)
    assert [r[0] for r in got.select("n").orderBy("n").collect()] == list(range(1, 20_001))
    near = skew.neighbours_in_order(df, "k.x", "t.y", [], 1, 1, 500)
    assert near.filter("prev_1 is null").count() == near.filter("next_1 is null").count() == 1


@pytest.mark.parametrize("counters", [50, 100_000])
@pytest.mark.parametrize("shape", ["even", "tied", "spread"])
def test_exact_quantiles(spark, shape, counters):
    """Few counters force the brackets, and their narrowing; the result stays exact."""
    import numpy as np
    rng = random.Random(3)
    draw = {"even": lambda: float(rng.randrange(3000)), "tied": lambda: float(rng.choice([0] * 9 + [rng.randrange(500)])),
            "spread": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200)}[shape]
    data = [(g, draw(), draw() if rng.random() < 0.8 else None) for g in ("a", "b", None) for _ in range(1 + 900 * (g is not None))]
    df = spark.createDataFrame(data, "`g.x` string, v double, `w.x` double")
    probabilities = [0.0, 0.5, 0.9]
    got = {r[0]: r[1:] for r in skew.exact_quantiles(df, ["g.x"], ["v", "w.x"], probabilities, counters).collect()}
    for g in ("a", "b", None):
        want = []
        for column in (1, 2):
            have = [r[column] for r in data if r[0] == g and r[column] is not None]
            want += np.quantile(have, probabilities).tolist() if have else [None] * 3
        assert list(got[g]) == [pytest.approx(x, rel=1e-9) if x is not None else None for x in want]


def test_exact_quantile_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert skew.exact_quantile(df, [], "v", 0.5).first()["quantile"] == 50.0
    assert skew.exact_quantile(df, [], "v", 0.5, counters=3).first()["quantile"] == 50.0
    assert skew.global_quantiles(df.limit(0), "v", [0.5]) == []


def test_dotted_names(spark):
    data = [("a", 1.0, 1), ("a", 3.0, 2), (None, 5.0, 3)]
    df = spark.createDataFrame(data, "`k.x` string, `m.n` double, `t.u` int")
    assert rows(A.count_by(df, "k.x")) == [("a", 2), (None, 1)]
    got = A.stats_by(df, ["k.x"], ["m.n"], ["mean", "median", "sum"])
    assert got.columns == ["k.x", "m.n_mean", "m.n_median", "m.n_sum"] and rows(got) == [("a", 2.0, 2.0, 4.0), (None, 5.0, 5.0, 5.0)]
    assert rows(A.distinct_by(df, ["k.x"], "m.n")) == [("a", 2), (None, 1)]
    assert rows(A.count_nonnull_by(df, ["k.x"], "m.n")) == [("a", 2), (None, 1)]
    assert rows(A.mean_all_by(df, "k.x", ["m.n"])) == [("a", 2.0), (None, 5.0)]
    assert rows(A.attach_group_stats(df, ["k.x"], ["m.n"], ["max"])) == [("a", 1.0, 1, 3.0), ("a", 3.0, 2, 3.0), (None, 5.0, 3, 5.0)]
    assert rows(A.attach_distinct_counts(df, ["k.x"], "t.u")) == [("a", 1.0, 1, 2), ("a", 3.0, 2, 2), (None, 5.0, 3, 1)]
    assert rows(W.group_broadcast(df, "k.x", ["m.n"], ["min"])) == [("a", 1.0, 1, 1.0), ("a", 3.0, 2, 1.0), (None, 5.0, 3, 5.0)]
    assert W.neighbour_sessions(df, "k.x", "t.u", ["m.n"], 1).count() == 3
    assert rows(W.row_number_per_key(df, "k.x", "t.u", ["m.n"]).select("`t.u`", "n")) == [(1, 1), (2, 2), (3, 1)]
    assert W.first_n_per_key(df, "k.x", "t.u", ["m.n"], 1).count() == 2


def test_dense_codes(spark):
    df = spark.createDataFrame([("a", f"x{i:03d}") for i in range(200)] + [("b", "z"), ("b", "y"), ("b", "z")], "g string, v string")
    got = {(r["g"], r["v"]): r["code"] for r in skew.dense_codes(df.repartition(4), "g", "v").collect()}
    assert got[("b", "y")] == 1 and got[("b", "z")] == 2
    assert [got[("a", f"x{i:03d}")] for i in range(200)] == list(range(1, 201))


def test_nullsafe_join_and_suffix(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    got = J.left_join_nullsafe(left, right, "k", "_g", right_rows=2)
    assert got.columns == ["k", "v", "v_g"]
    assert rows(got) == [("a", 1, 10), (None, 2, 20)]


def test_broadcast_only_below_bound(spark):
    left, right = spark.range(10).toDF("k"), spark.range(10).toDF("k")
    hinted = J.bounded(right, 10)._jdf.queryExecution().logical().toString()
    free = J.bounded(right, skew.BROADCAST_ROWS + 1)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in hinted or "UnresolvedHint" in hinted
    assert "Hint" not in free and left is not None


def test_sum_of_nothing_is_zero_and_mean_is_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    got = A.stats_by(df, ["g"], ["x"], ["sum", "mean", "min", "var"]).first()
    assert got[1:] == (0.0, None, None, None)


def test_attach_group_stats_has_a_null_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 3.0), (3, None, 5.0)], "id int, g string, x double")
    got = A.attach_group_stats(df, ["g"], ["x"], ["mean", "count"]).select("id", "x_mean_g", "x_count_g")
    assert rows(got) == [(1, 1.0, 1), (2, 4.0, 2), (3, 4.0, 2)]


def test_median_switches_method(spark, monkeypatch):
    monkeypatch.setattr(A, "COUNTER_VALUES", 3)
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 1.0), (None, 2.0)], "g string, x double")
    got = {r["g"]: (r["x_median"], r["x_count"]) for r in A.stats_by(df, ["g"], ["x"], ["median", "count"]).collect()}
    assert got == {"a": (5.0, 11), "b": (1.0, 1), None: (2.0, 1)}


def test_group_broadcast_conventions(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 7.0), (4, None, 9.0)], "id int, g string, x double")
    group = W.group_broadcast(df, "g", ["x"], ["mean"]).select("id", "x_mean_g")
    own = W.group_broadcast(df, "g", ["x"], ["mean"], keep_ungrouped=True).select("id", "x_mean_g")
    assert rows(group) == [(1, 2.0), (2, 2.0), (3, 8.0), (4, 8.0)]
    assert rows(own) == [(1, 2.0), (2, 2.0), (3, 7.0), (4, 9.0)]


def test_first_n_limits_before_the_shuffle(skewed):
    out = W.first_n_per_key(skewed, "visitor", "start", ["id"], 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert out.groupBy("visitor").count().agg(F.max("count")).first()[0] == 30


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None, None, float("nan")), (2, "x", "y", None, float("nan"))],
                               "varies int, same string, half string, none string, nan double")
    assert K.fit_varying_cols(df) == ["varies", "half"]


def test_sparse_columns_keep_all_when_none_match(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    assert K.drop_sparse_cols(df, 0.9).columns == ["a", "b"]
    assert K.drop_sparse_cols(df, 0.4).columns == ["a"]


def test_near_zero_var(spark):
    df = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 960, "a").otherwise("b").alias("mostly"),
        F.when(F.col("id") < 500, "a").otherwise("b").alias("even"), F.lit(1).alias("one"),
        F.lit(None).cast("int").alias("none"))
    assert K.near_zero_var_cols(df) == ["mostly", "one", "none"]


def test_label_codes_null_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("B",)], "c string")
    codes = E.fit_label_codes(train, ["c"])
    new = spark.createDataFrame([("a",), ("zz",), (None,), ("b",), ("B",)], "c string")
    assert [r["c"] for r in E.apply_label_codes(new, codes).orderBy(F.lit(1)).collect()].count(None) == 2
    pairs = {r["value"]: r["code"] for r in codes.table.collect()}
    assert pairs == {"B": 1, "a": 2, "b": 3}


@pytest.mark.parametrize("listed", [0, 200])
def test_label_codes_by_list_and_by_join_agree(spark, monkeypatch, listed):
    monkeypatch.setattr(E, "LISTED_LEVELS", listed)
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "b", "w")], "id int, c string, e string")
    assert rows(E.label_encode(df, ["c", "e"])) == [(1, 2, 2), (2, 1, None), (3, None, 2), (4, 2, 1)]


def test_lump_and_one_hot(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [("c",)] + [(None,)], "f string")
    lumped = E.explicit_na(E.lump_rare(df, E.fit_kept_levels(df, ["f"], 0.05)), ["f"])
    assert {r["f"] for r in lumped.collect()} == {"a", "b", "Other", "(Missing)"}
    wide = E.one_hot(lumped.withColumn("g", F.col("f")), {c: ["(Missing)", "Other", "a", "b"] for c in ("f", "g")})
    assert wide.columns == ["f(Missing)", "fOther", "fa", "fb", "gOther", "ga", "gb"]
    hot = {(r["f"], tuple(r["hot"].toArray())) for r in E.one_hot_vector(df, ["f"]).collect()}
    assert hot == {(None, (1, 0, 0, 0)), ("a", (0, 1, 0, 0)), ("b", (0, 0, 1, 0)), ("c", (0, 0, 0, 1))}


def test_one_hot_query_keeps_a_rare_level(spark, tmp_path):
    kind = F.when(F.col("id") == 7, "RARE").when(F.col("id") == 8, F.lit(None)).otherwise("ECONOMY")
    spark.range(20_000).select(F.col("id").alias("p_partkey"), kind.alias("p_type"), (F.col("id") % 40).alias("p_size")).write.parquet(
        f"{tmp_path}/part.parquet")
    out = scalar_queries.one_hot(spark, str(tmp_path))
    assert [r["p_partkey"] for r in out.where("p_typeRARE = 1").collect()] == [7]


def test_one_hot_of_more_than_a_thousand_levels(spark):
    df = spark.range(1500).selectExpr("concat('level', id) AS f")
    first = E.one_hot_vector(df, ["f"]).where("f = 'level0'").first()["hot"]
    assert (first.size, first.indices.tolist()) == (1501, [1])


def test_sorts_are_in_order(spark, sf_dir):
    from sessionlab.catalog import QUERIES
    for name, key in (("sort_by_date", ("o_orderdate", "o_orderkey")), ("sort_multi", ("user_id", "ts", "event_id"))):
        got = [tuple(r[k] for k in key) for r in QUERIES[name](spark, sf_dir).collect()]
        assert got == sorted(got)


def test_csv_columns_go_by_name(spark, tmp_path):
    from sessionlab.sources.readers import scan_typed_csv
    from sessionlab.sources.schemas import struct
    (tmp_path / "a.csv").write_text("device,id\ndev,0123\n")
    (tmp_path / "b.csv").write_text("id,extra,device\n0456,x,other\n")
    schema = struct(id="string", device="string")
    got = scan_typed_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema)
    assert rows(got) == [("0123", "dev"), ("0456", "other")]
    with pytest.raises(ValueError):
        scan_typed_csv(spark, str(tmp_path / "a.csv"), struct(id="string", lacking="string"))


def test_joins_on_names_with_dots(spark):
    from sessionlab.operators.joins import left_join_nullsafe
    a = spark.createDataFrame([(1, "x"), (2, None)], "v int, `k.a` string")
    b = spark.createDataFrame([("x", 7), (None, 8)], "`k.a` string, w int")
    assert rows(left_join_nullsafe(a, b, "k.a").select("v", "w")) == [(1, 7), (2, 8)]


def test_union_fill_and_align(spark):
    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2.0,)], "c double")
    assert rows(J.union_fill(a, b, sort_columns=True)) == [("x", 1, None), (None, None, 2.0)]
    left, right = J.align_columns(a, spark.createDataFrame([("y", 5)], "a string, z int"))
    assert left.columns == right.columns == ["a"]


def test_period_lookup_is_half_open(spark):
    df = spark.sql("SELECT * FROM VALUES (date'2017-01-01'), (date'2017-01-05'), (date'2017-01-09') t(d)")
    got = J.period_lookup(df, "d", [("2017-01-01", "2017-01-05", 0), ("2017-01-05", "2017-01-09", 1)])
    assert [r["period"] for r in got.orderBy("d").collect()] == [0, 1, None]


def test_folds_are_disjoint_and_keep_visitors_together(skewed):
    folds = L.group_kfold(skewed, "visitor", 5)
    assert folds.filter(~F.col("fold").between(0, 4)).count() == 0
    assert folds.groupBy("visitor").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_stratified_split_takes_exact_share(spark):
    df = spark.range(1003).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id") * 1.5).otherwise(0.0).alias("y"))
    split = L.fit_stratified_split(df, "y", "id", 0.75)
    out = L.apply_stratified_split(df, split)
    assert out.filter("is_train").count() == 753  # one bucket: ceil(0.75 * 1003)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_expanding_folds_leave_a_gap(spark):
    df = spark.sql("SELECT explode(sequence(date'2016-08-01', date'2017-08-01')) AS d")
    out = L.expanding_time_folds(df, "d")
    counts = out.groupBy("role_1").count().collect()
    assert {r["role_1"]: r["count"] for r in counts} == {"train": 107, "valid": 50, None: 209}


def test_blend_matches_by_id(spark):
    a = spark.createDataFrame([("u", 1.0), ("v", 2.0)], "id string, s double")
    b = spark.createDataFrame([("v", 20.0), ("u", 10.0)], "id string, s double")
    assert rows(S.blend([a, b], [0.5, 0.5], "id", "s")) == [("u", 5.5), ("v", 11.0)]
    with pytest.raises(ValueError):
        S.blend([a], [0.5, 0.5], "id", "s")


def test_fixed_blend_weights_sum_to_one():
    from sessionlab.sources.schemas import BLEND_WEIGHTS
    assert sum(BLEND_WEIGHTS) == pytest.approx(1.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (5.0, 1), (10.0, 1), (None, 1)], "x double, same int")
    assert rows(P.histogram(df, 2)) == [("same", 1, 4), ("x", 1, 1), ("x", 2, 2)]


def test_five_number_methods_agree(spark, monkeypatch):
    df = spark.range(1, 12).select(F.col("id").cast("double").alias("x"))
    plain = P.five_number(df, "x").first()[:]
    monkeypatch.setattr(skew, "COUNTER_VALUES", 2)
    assert P.five_number(df, "x").first()[:] == plain == (1.0, 3.5, 6.0, 6.0, 8.5, 11.0)


def test_boosting_stops_within_rounds_and_predicts_missing(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("f"),
                                 F.when(F.col("id") % 5 > 0, F.rand(1)).alias("gap"),
                                 (F.col("id") % 7 > 3).cast("double").alias("y"), (F.col("id") % 4 == 0).alias("val"))
    settings = M.BoostSettings(max_iter=5, depth=2, step=0.5, min_rows=1)
    matrix = M.assemble(df, ["f", "gap"], "y", keep=["id", "val"])
    model = M.fit_boosted(matrix, "y", "val", settings)
    assert 1 <= model.getNumTrees <= 5
    assert model.transform(matrix).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.2
    top = M.feature_importance(model, ["f", "gap"], spark, 1).first()
    assert top["feature"] == "f"


def test_pca_variance_does_not_increase(spark):
    df = spark.range(300).select((F.col("id") % 11).alias("a"), (F.col("id") % 11 + F.rand(2)).alias("b"), F.rand(3).alias("c"))
    columns = ["a", "b", "c"]
    out = M.apply_pca(df, columns, M.fit_pca(df, columns, 3))
    variances = list(out.agg(*[F.var_samp(f"PC{i}") for i in (1, 2, 3)]).first())
    assert variances == sorted(variances, reverse=True)
    assert sum(variances) == pytest.approx(3.0)
