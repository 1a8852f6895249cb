"""Column builders and literals on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sessionlab.functions import columns as C
from sessionlab.functions.literals import parse_failures, parse_pyliteral, strip_sentinel
from sessionlab.operators import nested as N
from sessionlab.sources import schemas as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("r")).first()["r"]


def test_cross_feature_null_and_paste_na(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    got = [tuple(r) for r in df.select(C.cross_feature("x", "y"), C.paste_feature("x", "y")).collect()]
    assert got == [(None, "a_NA"), ("a_b", "a_b")]


@pytest.mark.parametrize("day, week", [("2017-01-01", 1), ("2017-01-07", 1), ("2017-01-08", 2), ("2016-12-31", 53)])
def test_week_is_seven_day_block(spark, day, week):
    assert one(spark, dt.date.fromisoformat(day), C.week_block("c"), "date") == week


def test_wday_and_qday(spark):
    sunday = dt.date(2017, 4, 2)
    assert one(spark, sunday, F.dayofweek("c"), "date") == 1
    assert one(spark, sunday, C.day_in_quarter("c"), "date") == 2


def test_round_is_half_even(spark):
    assert one(spark, 2.5, C.round_result("c", 0), "double") == 2.0


def test_flags_and_labels(spark):
    df = spark.createDataFrame([("5", 1.0), ("bad", -1.0), (None, None)], "t string, v double")
    got = [tuple(r) for r in df.select(C.log_label("t"), C.binary_label("t"), C.presence_flag("v"), C.clip_negative("v")).collect()]
    assert got == [(math.log1p(5), 1, 1, 1.0), (0.0, 0, 1, 0.0), (0.0, 0, 0, None)]


def test_type3_moments_match_closed_form(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 9.0]
    n, mean = len(xs), sum(xs) / len(xs)
    m2, m3, m4 = (sum((x - mean) ** p for x in xs) / n for p in (2, 3, 4))
    sd = math.sqrt(m2 * n / (n - 1))
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    skew, kurt = df.agg(C.skewness_type3("x"), C.kurtosis_type3("x")).first()
    assert skew == pytest.approx(m3 / sd**3)
    assert kurt == pytest.approx(m4 / sd**4 - 3)


def test_moments_of_constant_and_single(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    got = {r[0]: r[1:] for r in df.groupBy("g").agg(F.var_samp("x"), C.skewness_type3("x")).collect()}
    assert got == {"a": (None, None), "b": (0.0, None)}


def test_distinct_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "x string")
    assert df.agg(C.distinct_with_null("x"), F.count_distinct("x")).first()[:] == (2, 1)


LITERALS = [
    ("[{'index': '4', 'value': 'North America'}]", "North America"),
    ("[{'index': '4', 'value': \"Men's\"}]", "Men's"),
    ("[{'index': '4', 'value': 'True Grit'}]", "True Grit"),
    ("[{'index': '4', 'value': 'None, True, False'}]", "None, True, False"),
    ("[{'index': '4', 'value': 'a\\xa0b'}]", "a b"),
    ("[{'index': '4', 'value': 'it\\'s \"x\"'}]", "it's \"x\""),
    ("[{'index': True, 'value': None}]", None),
    ("[{'value': 'back\\\\xa0slash'}]", "back\\xa0slash"),
    ("[]", None),
    (None, None),
]


@pytest.mark.parametrize("text, value", LITERALS)
def test_python_literal(spark, text, value):
    got = one(spark, text, N.array_first(parse_pyliteral("c", X.DIMENSIONS))["value"])
    assert got == value


def test_bare_true_becomes_boolean(spark):
    kind = X.struct(a="boolean", b="boolean", c="string")
    assert tuple(one(spark, "{'a': True, 'b': False, 'c': None}", parse_pyliteral("c", kind))) == (True, False, None)


def test_failures_are_counted(spark):
    df = spark.createDataFrame([("[{'index': '1'}]",), ("[{'index': ",), (None,)], "t string")
    parsed = df.withColumn("p", parse_pyliteral("t", X.DIMENSIONS))
    assert parsed.agg(parse_failures("t", X.DIMENSIONS)).first()[0] == 1


@pytest.mark.parametrize("text, left", [
    ('{"a": "x", "b": "1"}', '{"b": "1"}'),
    ('{"b": "1", "a": "x"}', '{"b": "1"}'),
    ('{"a": "x"}', "{}"),
    ('{"a": "x", "c": "x", "b": "1", "d": "x"}', '{"b": "1"}'),
])
def test_strip_sentinel(spark, text, left):
    assert one(spark, text, strip_sentinel("c", "x")) == left


def test_infer_schema_is_union_of_keys(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": {"c": "x"}, "a": 2.5}',), ("broken",)], "j string")
    flat = N.json_flatten(df, {"j": N.json_infer_schema(df, "j")})
    assert set(flat.columns) == {"a", "b.c"}
    assert [tuple(r) for r in flat.select("a", "`b.c`").collect()][:2] == [(1.0, None), (2.5, "x")]


def test_empty_array_keeps_row(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "[{'index': '7', 'value': 'v'}]")], "id int, t string")
    dims = N.literal_eval(df, "t", X.DIMENSIONS)
    assert [tuple(r) for r in N.dimension_explode(dims, "t").collect()] == [(1, None, None), (2, "7", "v")]
    assert N.drop_null_nested(dims, "t").count() == 1
