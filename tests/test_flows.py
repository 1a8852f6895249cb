"""The flows on the session export of the small tables."""

import inspect

import pytest
from pyspark.sql import functions as F

from sessionlab.catalog import flow_queries
from sessionlab.catalog.inputs import raw_sessions
from sessionlab.operators.modelling import BoostSettings, assemble, best_round, fit_boosted
from sessionlab.plans import hits_flatten, leave_month_out, single_level, two_level
from sessionlab.plans.features import SINGLE_LEVEL, TWO_LEVEL, VISITOR, export_shape, parse_export, typed_sessions


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    raw = raw_sessions(spark, sf_dir)
    cut = F.col("date") < "20240120"
    return raw.filter(cut), raw.filter(~cut)


def test_first_hit_keeps_every_session(parts):
    train, test = parts
    assert hits_flatten.hits_table(train, test).count() == train.count() + test.count()


def test_hit_keys_outside_the_list_are_kept(spark):
    first = "[{'hitNumber': '1', 'latency': {'ms': 12, 'host': \"it's\"}, 'contentGroup': {'contentGroup1': 'a', 'contentGroup9': 'z'}, 'experiment': []}]"
    other = "[{'hitNumber': '2', 'exceptionInfo': {'isFatal': True}, 'promotionActionInfo': {'promoIsView': True}, 'publisher': [{'p': 'x'}]}]"
    frames = [spark.createDataFrame([("v", 5, t)], "fullVisitorId string, visitStartTime long, hits string") for t in (first, other)]
    out = {r["hitNumber"]: r.asDict() for r in hits_flatten.hits_table(*frames).collect()}
    assert (out[1]["latency_ms"], out[1]["latency_host"], out[1]["contentGroup_contentGroup1"], out[1]["contentGroup_contentGroup9"]) == (
        12, "it's", "a", "z")
    assert out[2]["latency_ms"] is None and out[2]["exceptionInfo_isFatal"] and out[2]["promotionActionInfo_promoIsView"]
    assert [r["p"] for r in out[2]["publisher"]] == ["x"] and "experiment" not in out[1]
    empty = [f.limit(0) for f in frames]
    assert hits_flatten.hits_table(*empty).count() == 0


def test_flow_c_parses_all_hit_keys(parts):
    train, test = (p.withColumn("hits", F.regexp_replace("hits", "'hitNumber'", "'rare': 'r', 'many': ['a'], 'hitNumber'")) for p in parts)
    parsed = [parse_export(p, with_lists=True) for p in (train, test)]
    out = typed_sessions(parsed[0], False, export_shape(*parsed))
    assert out.filter("rare = 'r'").count() == out.filter("hitNumber is not null").count() > 0
    assert "many" not in out.columns


def test_all_json_keys_and_failures(parts):
    """Keys that no schema declares, a name that another column has, texts that do not parse."""
    train, test = parts
    more = F.regexp_replace("totals", "^\\{", '{"timeOnSite": 31, "sessionQuality": {"dim": "4"}, "browser": "lynx", "list": [1], ')
    train = train.withColumn("totals", F.when(F.col("visitId") % 2 == 0, more).when(F.col("visitId") % 10 == 1, "{broken").otherwise(F.col("totals")))
    train = train.withColumn("hits", F.when(F.col("visitId") % 10 == 3, "[{'broken'").otherwise(F.col("hits")))
    parsed = [parse_export(p, with_lists=True) for p in (train, test)]
    shape = export_shape(*parsed)
    assert shape.failures == {"device": 0, "geoNetwork": 0, "trafficSource": 0, "customDimensions": 0,
                              "totals": train.filter("visitId % 10 = 1").count(), "hits": train.filter("visitId % 10 = 3").count()}
    out = typed_sessions(parsed[0], False, shape)
    assert out.filter("timeOnSite = 31 and sessionQuality_dim = '4' and totals_browser = 'lynx'").count() == train.filter("visitId % 2 = 0").count()
    assert out.filter("timeOnSite is null").count() == train.filter("visitId % 2 = 1").count()
    assert "list" not in out.columns and out.filter("browser = 'lynx'").count() == 0
    assert {"timeOnSite", "totals_browser", "hits"} <= set(typed_sessions(parsed[1], True, shape).columns)


def test_features_do_not_change_the_row_count(parts):
    train, test = parts
    out = single_level.session_features(train, test)
    assert out.count() == train.count() + test.count()
    assert out.filter("is_test AND y IS NOT NULL").count() == 0
    assert out.filter("NOT is_test AND y IS NULL").count() == 0


@pytest.mark.parametrize("name,plan", [("single_level_scores", single_level), ("two_level_scores", two_level)])
def test_registered_flows_run_the_whole_job(spark, sf_dir, monkeypatch, name, plan):
    signature, calls = inspect.signature(plan.score_visitors), []

    class Stop(Exception):
        pass

    def record(*args, **kwargs):
        calls.append(signature.bind(*args, **kwargs))
        calls[0].apply_defaults()
        raise Stop

    monkeypatch.setattr(plan, "score_visitors", record)
    with pytest.raises(Stop):
        getattr(flow_queries, name)(spark, sf_dir)
    used = calls[0].arguments
    assert used["settings"] == (SINGLE_LEVEL if plan is single_level else TWO_LEVEL)
    assert used.get("v", 5) == 5 and used.get("components", 20) == 20
    boosts = [b for b in used.values() if isinstance(b, BoostSettings)]
    assert len(boosts) == (1 if plan is single_level else 2)
    assert all(b.max_iter == 5000 and b.depth >= 7 and b.bins == 255 and b.patience >= 100 for b in boosts)


def test_patience_outlasts_a_poor_round(spark):
    settings = BoostSettings(patience=2)
    assert best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.6, 1.0], settings) == (4, True)
    assert best_round([5.0, 4.0, 4.5], settings) == (2, False)
    assert best_round([3.0, 3.0, 3.0], settings) == (1, True)
    rows = [(float(k % 7), float((k * 13) % 5), float((k * k) % 11), k % 3 == 0) for k in range(60)]
    matrix = assemble(spark.createDataFrame(rows, "a double, b double, y double, val boolean"), ["a", "b"], "y", ["val"]).persist()
    settings = BoostSettings(max_iter=12, depth=2, step=0.5, min_rows=1, patience=3)
    whole = fit_boosted(matrix.filter("not val"), "y", None, settings).evaluateEachIteration(matrix.filter("val"), "squared")
    assert fit_boosted(matrix, "y", "val", settings).getNumTrees == best_round(whole, settings)[0]


@pytest.mark.slow
def test_full_two_level_features(parts):
    coded, features, shape = two_level.session_matrix(*parts)
    assert set(shape.failures.values()) == {0}
    assert coded.count() == sum(p.count() for p in parts)
    assert {"PC1", "PC20", "cD_value", "country_browser"} <= set(features)
    for key in ("country", "cD_value", "browser_dev", "hitNumber"):
        stats = {f"pageviews_{s}_{key}" for s in TWO_LEVEL.stats}
        assert key not in features or stats & set(features)


@pytest.mark.slow
def test_leave_month_out_flow(parts):
    train, test = parts
    out = leave_month_out.score_visitors(train, test, test.select(VISITOR).distinct(), BoostSettings(max_iter=1, depth=2, min_rows=1))
    assert out.table.filter("PredictedLogRevenue >= 0").count() == test.select(VISITOR).distinct().count()
    assert out.sessions.filter("pred is null").count() == 0 and len(out.errors) == out.sessions.select("fold_month").distinct().count()


@pytest.mark.slow
def test_template_order_and_unknown_visitors(spark, parts):
    train, test = parts
    template = test.select(VISITOR).distinct().union(spark.createDataFrame([("unknown",)], f"{VISITOR} string"))
    out = single_level.score_visitors(train, test, template, "2024-01-15", BoostSettings(max_iter=1, depth=2, min_rows=1))
    assert out.count() == template.count()
    assert [r["PredictedLogRevenue"] for r in out.filter(F.col(VISITOR) == "unknown").collect()] == [None]
