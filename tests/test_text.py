"""Literal fixtures for text functions, among them the CJK cases the data does not hold."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import params as P
from quillspark.functions import arrays as A
from quillspark.functions import jsonx as J
from quillspark.functions import numeric as N
from quillspark.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_strict_clean(spark):
    raw = "  60 km / h　 \t\u0007 a\nb  "
    assert one(spark, X.strict_clean, raw, "", None) == ["60km/h a b", "", ""]


def python_clean(text):
    text = re.sub(r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "", text or "")
    text = re.sub(r"\s+", " ", text)
    for rule in (r"(?<=\d) (?=[a-zA-Z])", r"(?<=[a-zA-Z]) (?=/)", r"(?<=/) (?=[a-zA-Z])"):
        text = re.sub(rule, "", text)
    return text.strip()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1٣ /\t\n　 \u0007第条", max_size=30), min_size=20, max_size=60))
def test_strict_clean_property(spark, texts):
    got = one(spark, X.strict_clean, *texts)
    assert got == [python_clean(x) for x in texts]
    assert one(spark, X.strict_clean, *got) == [python_clean(x) for x in got]


def test_clause(spark):
    assert one(spark, X.clause_number, "依据第九十一条规定", "见第12条，第13条", "没有") == [
        "第九十一条", "第12条", "明细条款"]
    # the character class holds 条 itself, so the match is greedy across it
    assert one(spark, X.clause_number, "见第12条和第13条") == ["第12条和第13条"]


def test_join_broken_lines(spark):
    assert one(spark, X.join_broken_lines, "句子没有\n结束。\n下一句", "a\n\n# b", "a\n- b") == [
        "句子没有结束。\n下一句", "a\n\n# b", "a\n- b"]


def test_markup_and_speech(spark):
    assert one(spark, X.scrub_markup, "<|DSML|x>文字</|DSML|>", "<dsml>x") == ["文字", "x"]
    assert one(spark, X.plain_speech, "# **a** `b` > [依据3][资料12][其他1]") == [" a b  [其他1]"]


def test_options(spark):
    assert one(spark, X.strip_option_prefix, "A. x", "B、x", "C：x", "D x", "Ax", "E. x") == [
        "x", "x", "x", "x", "Ax", "E. x"]


def test_nearby(spark):
    got = [tuple(r) for r in one(spark, X.nearby_parts, "南京南站附近的停车场", "新街口周边餐厅", "停车场")]
    assert got == [("南京南站", "停车场"), ("新街口", "餐厅"), ("停车场", "停车场")]


def test_weather(spark):
    assert one(spark, X.weather_icon, "小雨", "多云", "阴", "雪", "晴", "雨夹雪") == [
        "rain", "cloud", "cloud", "snow", "sun", "rain"]
    assert one(spark, X.forecast_icon, "晴转雨", "雨", "雪") == ["sun", "rain", "cloud"]


def test_tokenize(spark):
    assert one(spark, X.tokenize, "酒驾 罚款2000元, Übung-x", "") == [
        ["酒", "驾", "罚", "款", "2000", "元", "Übung", "x"], []]


def test_extension(spark):
    routes = one(spark, lambda c: X.parser_route(X.file_extension(c)), "a.PDF", "b.c.txt", "d.md",
                 "e.exe", "noext", "pdf")
    assert routes == ["pdf", "txt", "other", "rejected", "rejected", "pdf"]


def test_json(spark):
    assert one(spark, J.embedded_array, 'x ```json\n[1]\n``` [2] y', "none") == ["[1]\n [2]", ""]
    assert one(spark, J.embedded_object, 'x {"a": {"b": 1}} y', "{") == ['{"a": {"b": 1}}', ""]
    assert one(spark, J.string_array, '["a","b"]', None, "broken") == [["a", "b"], [], []]


def test_rounding(spark):
    df = spark.createDataFrame([(0.25,), (12.25,), (2.5,), (2.675,)], "x double")
    assert [r[0] for r in df.select(N.round_even(F.col("x"), 1)).collect()] == [0.2, 12.2, 2.5, 2.7]
    assert [r[0] for r in df.select(N.round_even(F.col("x"), 0)).collect()] == [0, 12, 2, 3]


def test_token_estimate(spark):
    assert one(spark, N.token_estimate, "abc", "", None) == [4, 0, 0]


def test_whole_days(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 23:00:00' a, TIMESTAMP_NTZ'2024-01-03 22:59:59' b")
    assert row.select(N.whole_days(F.col("b"), F.col("a"))).first()[0] == 1


@pytest.mark.parametrize("n", [0, 3, 8, 12])
def test_tail(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "x array<int>")
    assert df.select(A.tail(F.col("x"), 8)).first()[0] == list(range(n))[-8:]


def test_citations(spark):
    assert one(spark, X.cited_numbers, "a[资料1]b[资料12] [资料x]", "") == [[1, 12], []]


def test_constants():
    assert (P.CHUNK_SIZE, P.CHUNK_OVERLAP, P.DENSE_K, P.SPARSE_K) == (1200, 200, 40, 20)
