"""What grew faster than the input: copies of texts in a plan, wide rows in shuffles, arrays of all levels, a copy per fold."""

import os

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from sessionlab.catalog.inputs import raw_sessions
from sessionlab.catalog.scalar_queries import one_hot_many
from sessionlab.functions.literals import pyliteral_to_json
from sessionlab.operators import modelling as M
from sessionlab.operators.encoding import one_hot_vector
from sessionlab.sources import writers as Wr
from sessionlab.sources.readers import scan_typed_csv


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_literal_is_rewritten_from_one_copy_of_its_input(spark):
    texts = ["[True, 'True', \"it's None\", None]", "\u0001True [False]", "'\\x41\\\\x41\\xZZ' True_ None", "xFalse", "'open True", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    out = df.select("id", F.reverse("t").alias("r")).select("id", pyliteral_to_json(F.reverse("r")).alias("j")).filter(F.length("j") > 0)
    assert plan(out.select("id")).count("reverse(reverse(") == 1
    assert [r["j"] for r in out.orderBy("id").collect()] == [
        "[true, 'True', \"it's None\", null]", "\u0001true [false]", "'\\u0041\\\\x41\\xZZ' True_ null", "xfalse", "'open True"]


def test_texts_are_made_after_the_joins(spark, sf_dir):
    keyed = raw_sessions(spark, sf_dir, keyed=True)
    text = plan(keyed)
    assert "productSKU" in text and text.index("productSKU") < text.index("Join") and "productSKU" not in text[text.index("Join"):]
    assert "Repartition" in text[:text.index("Join")]
    assert keyed.drop("k").exceptAll(raw_sessions(spark, sf_dir)).count() == 0 and keyed.filter("k is null").count() == 0


def test_packed_csv_holds_all_rows_in_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Wr, "PACKED_ROWS", 10)
    df = spark.range(35).selectExpr("id", "concat('a \"b\", ', id) as t").coalesce(1)
    path = Wr.sink_csv(df, str(tmp_path / "packed"), Wr.PACKING)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 4 and all(f.endswith(".lz4") for f in files)
    assert sorted(map(tuple, scan_typed_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_one_hot_vector_names_no_slot_and_is_not_spread_out(spark, sf_dir):
    df = spark.createDataFrame([(1, "b", None), (2, None, "x"), (3, "a", "x")], "id int, a string, b string")
    hot = one_hot_vector(df, ["a", "b"])
    assert {r["id"]: r["hot"].toArray().tolist() for r in hot.collect()} == {
        1: [0, 0, 1, 1, 0], 2: [1, 0, 0, 0, 1], 3: [0, 1, 0, 0, 1]}
    assert hot.schema["hot"].metadata == {"ml_attr": {"num_attrs": 5}}
    assert "vector_to_array" not in plan(one_hot_many(spark, sf_dir)) and "UDF" in plan(hot)


def test_folds_share_one_stored_matrix(spark, monkeypatch):
    written, real = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, path: written.append(path) or real(df, path))
    rows = spark.createDataFrame([(i, i % 3, i % 2, float(i % 2 + i % 3)) for i in range(60)], "id int, fold int, a int, y double")
    matrix = M.assemble(rows, ["a"], "y", keep=["id", "fold", "a"])
    out = M.oof_predict(matrix, "y", M.k_folds("fold", 3), settings=M.BoostSettings(max_iter=1, depth=1, step=1.0, subsample=1.0, min_rows=1))
    assert len(written) == 1
    # a row of fold f is predicted by the mean of the other folds in its half
    assert {(r["fold"], r["a"]): round(r["pred"], 6) for r in out.train.collect()} == {
        (f, a): a + sum(g for g in range(3) if g != f) / 2 for f in range(3) for a in range(2)}
    assert M.fit_boosted(matrix.withColumn("v", F.col("fold") == 0), "y", "v", M.BoostSettings(max_iter=4, piece=2, depth=1, min_rows=1)).getNumTrees >= 1
    assert len(written) == 3  # its own copy, and one between its two pieces


def _waves(spark):
    """Rows whose label takes many small steps to learn; every third is for validation."""
    rows = [(float(k % 17), float((k * 13) % 23), float((k % 17) * ((k * 13) % 23) % 29), k % 3 == 0) for k in range(360)]
    return M.assemble(spark.createDataFrame(rows, "a double, b double, y double, val boolean").coalesce(1), ["a", "b"], "y", ["val"]).persist()


def test_a_round_looks_for_no_splits(spark):
    matrix, jobs = _waves(spark), []
    for rounds in (3, 8):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        M.fit_boosted(matrix, "y", "val", M.BoostSettings(max_iter=rounds, depth=2, min_rows=1))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 5 * 2  # a job for each level of each tree, no other


def test_rounds_are_fitted_to_what_is_left(spark):
    matrix = _waves(spark)
    settings = M.BoostSettings(max_iter=5, depth=3, step=0.3, subsample=1.0, min_rows=2)
    rows = matrix.select("*", F.col("y").alias("rest"))
    for k in range(5):
        tree = DecisionTreeRegressor(labelCol="rest", maxDepth=3, maxBins=255, minInstancesPerNode=2).fit(rows)
        rows = tree.setPredictionCol("t").transform(rows).withColumn("rest", F.col("rest") - (0.3 if k else 1.0) * F.col("t")).drop("t")
    wanted = [r[0] for r in rows.select(F.col("y") - F.col("rest")).collect()]
    found = M.fit_boosted(matrix, "y", None, settings).transform(matrix)
    assert [r[0] for r in found.select("prediction").collect()] == pytest.approx(wanted)


def test_rounds_go_on_while_the_error_falls(spark):
    matrix = _waves(spark)
    settings = M.BoostSettings(max_iter=40, depth=3, step=0.2, min_rows=1, patience=3, piece=1)  # the first look is after 4 rounds
    whole = M.fit_boosted(matrix.filter("not val"), "y", None, settings).evaluateEachIteration(matrix.filter("val"), "squared")
    found = M.fit_boosted(matrix, "y", "val", settings).getNumTrees
    assert found == M.best_round(whole, settings)[0] and found > 4
    with pytest.raises(ValueError):
        M.fit_boosted(matrix.withColumn("none", F.lit(False)), "y", "none", settings)
