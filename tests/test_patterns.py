"""The linear-time Java forms find exactly the matches Python's re finds."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave import config as C
from logweave.functions.text import jre, sub_matches

ALPHABET = "aZ9._+-@/=xé中 \n"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=40)


def _spark_matches(spark, rows, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", F.regexp_extract_all("t", F.lit(jre(pattern)), 0).alias("m")).collect()
    return {r["i"]: list(r["m"]) for r in got}


@settings(max_examples=25, deadline=None)
@given(texts)
def test_email_fast_form_same_matches(spark, rows):
    rows = rows + ["a.b@c.de x@y.zz", "a@b.cc.d@e.ff", "é@x.yy", "--@-.ab", "u1@mail.example.com"]
    want = {i: [m.group() for m in re.finditer(C.ENTITY_PATTERNS[C.EMAIL], t)] for i, t in enumerate(rows)}
    assert _spark_matches(spark, rows, C.FAST_FORMS[C.EMAIL]) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB9+/= .", min_size=70, max_size=200), min_size=1, max_size=20))
def test_base64_fast_form_same_matches(spark, rows):
    rows = rows + ["Q" * 85 + "==" + "R" * 81, "x" * 79 + " " + "y" * 80]
    want = {i: [m.group() for m in re.finditer(C.BASE64_PATTERN, t)] for i, t in enumerate(rows)}
    assert _spark_matches(spark, rows, C.FAST_FORMS["BASE64"]) == want


@settings(max_examples=20, deadline=None)
@given(texts)
def test_sub_matches_equals_python_sub(spark, rows):
    rows = rows + ["", "@", "a@b.cc", "a@b.cc tail", "lead a@b.cc", "\ue000 a@b.cc"]
    pat = C.ENTITY_PATTERNS[C.EMAIL]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    out = df.select("i", sub_matches(F.col("t"), jre(pat), lambda m: F.concat(F.lit("<"), F.upper(m), F.lit(">"))).alias("o"))
    got = {r["i"]: r["o"] for r in out.collect()}
    want = {i: re.sub(pat, lambda m: "<" + m.group().upper() + ">", t) for i, t in enumerate(rows)}
    assert got == want


def test_builtin_patterns_unicode_like_python(spark):
    rows = ["发送至alice@example.com", "IP地址192.168.1.1", "来源 IP: 192.168.1.100", "4111 1111 1111 1111 foo",
            "13812345678@qq.com", "ID 110101199003077814 x", "a@mail.example.com"]
    for ent in C.REGEX_ENTITIES:
        pat = C.FAST_FORMS.get(ent, C.ENTITY_PATTERNS[ent])
        want = {i: [m.group() for m in re.finditer(C.ENTITY_PATTERNS[ent], t)] for i, t in enumerate(rows)}
        assert _spark_matches(spark, rows, pat) == want, ent


def test_marker_character_in_text_takes_exact_path(spark):
    mark = "\ue000"  # the marker the fast paths cut at
    rows = [f"a{mark}b x@y.zz {mark}", f"{mark}", f"u@v.ww{mark}p@q.rr", "plain u@v.ww"]
    pat = C.ENTITY_PATTERNS[C.EMAIL]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    out = df.select("i", sub_matches(F.col("t"), jre(pat), lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("o"))
    got = {r["i"]: r["o"] for r in out.collect()}
    assert got == {i: re.sub(pat, lambda m: "<" + m.group() + ">", t) for i, t in enumerate(rows)}
    from logweave.operators.redact import redact

    cfg = C.RedactionConfig("k", C.built_in_rules(C.Mask, [C.EMAIL]))
    red = {r["i"]: r["t"] for r in redact(df, "t", cfg).collect()}
    assert red[0] == f"a{mark}b x***** {mark}" and red[3] == "plain u*****"
