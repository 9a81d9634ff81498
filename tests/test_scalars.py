"""Scalar helpers and glob patterns."""

from __future__ import annotations

import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import glob, scalars


def check(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("pattern", "key", "hit"),
    [
        ("*", "abc", True), ("a*", "abc", True), ("a*", "bc", False), ("*c", "abc", True), ("a?c", "abc", True), ("a?c", "ac", False),
        ("[ab]x", "bx", True), ("[ab]x", "cx", False), ("[a-c]x", "bx", True), ("[^a]x", "bx", True), ("[!a]x", "ax", False),
        ("[]]x", "]x", True), ("a[b", "a[b", True), ("a.b", "axb", False), ("a\\*", "a\\b", True), ("", "", True), ("", "a", False),
        ("user:*:name", "user:42:name", True), ("a*b*c", "aXXbYYc", True), ("a*b*c", "aXXcYYb", False), ("exact", "exact", True), ("??", "é", True), ("?", "é", False), ("a*", "a\nb", True),
    ],
)
def test_glob(spark, pattern, key, hit):
    assert check(spark, glob.matches(F.col("key"), pattern), [(key,)], "key string") == [hit]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?", max_size=6), st.text(alphabet="abc", max_size=6))
def test_glob_regex_like_fnmatch(pattern, key):
    import re

    regex = glob.to_regex(pattern).replace("\\z", "\\Z")
    assert bool(re.search(regex, key)) == fnmatch.fnmatchcase(key, pattern)


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a",)], "key string").write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").filter(glob.matches(F.col("key"), "ab*c"))._jdf.queryExecution().toString()
    assert "StringStartsWith(key,ab)" in plan


def test_fnv(spark):
    texts = [("a",), ("foobar",), ("é€:x",), ("",)]
    assert check(spark, scalars.fnv1a32(F.col("t")), texts, "t string") == [0xE40C292C, 0xBF9CF968, 2246181570, 2166136261]


def test_parse_long(spark):
    rows = [("12",), ("+5",), ("-9223372036854775808",), ("9223372036854775808",), ("1.5",), ("",), ("x",), (" 1",), (None,)]
    assert check(spark, scalars.parse_long(F.col("t")), rows, "t string") == [12, 5, -(2**63), None, None, None, None, None, None]


def test_codecs(spark):
    rows = [("a b+c/é*~",), ("",), ("plain",)]
    assert check(spark, scalars.percent_encode(F.col("t")), rows, "t string") == ["a%20b%2Bc%2F%C3%A9%2A~", "", "plain"]
    assert check(spark, scalars.percent_decode(scalars.percent_encode(F.col("t"))), rows, "t string") == [r[0] for r in rows]
    assert check(spark, scalars.percent_decode(F.col("t")), [("a+b",), ("%zz",)], "t string") == ["a+b", None]
    back = F.decode(scalars.unbase64url(scalars.base64url(F.encode(F.col("t"), "UTF-8"))), "UTF-8")
    assert check(spark, back, rows, "t string") == [r[0] for r in rows]


def test_base64url_is_one_line(spark):
    import base64

    texts = ["é" + "x" * n for n in (54, 55, 56, 57, 58, 59, 61, 200, 1000)]
    coded = scalars.base64url(F.encode(F.col("t"), "UTF-8"))
    assert check(spark, coded, [(t,) for t in texts], "t string") == [base64.urlsafe_b64encode(t.encode()).decode().rstrip("=") for t in texts]
    back = F.decode(scalars.unbase64url(coded), "UTF-8")
    assert check(spark, back, [(t,) for t in texts], "t string") == texts


def test_namespace(spark):
    rows = [("a-b_9",), ("",), ("x" * 65,), ("a b",), ("a\n",)]
    assert check(spark, scalars.namespace_ok(F.col("t")), rows, "t string") == [True, False, False, False, False]
