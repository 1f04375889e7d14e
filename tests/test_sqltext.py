import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spendtrace.functions import sqltext as S


def py_clean(text):
    text = re.sub(r"--[^\n]*\n", "\n", text)
    text = re.sub(r"/\*.*?\*/", " ", text)
    return re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ")


def py_normalize(text):
    return re.sub(r"\s+", " ", (text or "").strip().upper()).rstrip(";")


def py_normalize_latency(text):
    text = re.sub(r"--[^\n]*\n", "\n", (text or "").strip())
    text = re.sub(r"/\*.*?\*/", " ", text)
    return re.sub(r"\s+", " ", text.upper()).rstrip(";")


PIECES = st.lists(
    st.sampled_from(
        ["select", "A", "x", " ", "  ", "\t", "\n", "\r\n", ";", ";;", "--", "/*", "*/", "-- c\n", "/* c */", "é",
         " ", " ", "　", "'", "\\n", "$1"]
    ),
    max_size=12,
).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=30, max_size=60))
def test_against_plain_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(
        "t",
        S.clean_query_text("t").alias("clean"),
        S.normalize_sql("t").alias("norm"),
        S.normalize_sql_latency("t").alias("lat"),
        S.has_text("t").alias("has"),
    )
    for r in df.collect():
        if r.t is not None:
            # A no-break space is no ASCII whitespace: the cleaning step keeps it.
            assert r.clean == py_clean(r.t), repr(r.t)
        assert r.norm == py_normalize(r.t), repr(r.t)
        assert r.lat == py_normalize_latency(r.t), repr(r.t)
        assert r.has == (r.norm != "") == (r.lat != ""), repr(r.t)


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first().x


def test_comment_needs_its_newline(spark):
    assert one(spark, S.clean_query_text("t"), "a -- c\nb") == "a b"
    assert one(spark, S.clean_query_text("t"), "a -- c") == "a -- c"


def test_block_comment_stays_within_a_line(spark):
    assert one(spark, S.clean_query_text("t"), "a /* x */ b") == "a b"
    assert one(spark, S.clean_query_text("t"), "a /* x\n y */ b") == "a /* x y */ b"


def test_leading_marker_leaves_a_blank(spark):
    assert one(spark, S.normalize_sql_latency("t"), "-- marker\nselect 1;") == " SELECT 1"
    assert one(spark, S.normalize_sql("t"), "-- marker\nselect 1;") == "-- MARKER SELECT 1"


def test_repairs_and_fragment(spark):
    fixed = S.normalize_sql("t", [(r"item\s*_name", "items_name")])
    assert one(spark, fixed, "select item _name") == "SELECT ITEMS_NAME"
    assert one(spark, S.sql_fragment(S.normalize_sql("t"), 5), "select 1") == "SELEC"
    assert one(spark, S.sql_fragment(F.col("t"), None), "abc") == "abc"
