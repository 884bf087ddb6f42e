"""Scalar text functions (O-S1 … O-S22), incl. the carried-over offline asserts."""

import re

from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.functions import text as T


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


# --- pure-Python statements of the rules, written from the rule text -------
def py_clean(t):
    return re.sub(r"\s+", " ", t).strip() if t else ""


def py_bullets(t):
    if not t:
        return []
    out = [py_clean(x) for x in re.split(r"[•·●◆◇▪▸▹►▻‣⁃⦿✦✧⬩⬨⬦▪️▫️-]\s*|\n+|(?:\d+[.)])\s*", t)]
    out = [x for x in out if x and len(x) > 10]
    if len(out) < 2:
        out += [x for x in (py_clean(s) for s in re.split(r"(?<=[.!?])\s+", t)) if x and len(x) > 15]
    return out[:50]


def py_fp(t):
    return re.sub(r"\s+", " ", t.lower().strip())[:100]


def test_clean_text_f4(spark):
    assert one(spark, T.clean_text("t"), "  Hello   World  ") == "Hello World"
    assert one(spark, T.clean_text("t"), "  ") == ""
    assert one(spark, T.clean_text("t"), None) == ""
    # NBSP, em space, \x1c (Python whitespace), BOM is not Python whitespace
    assert one(spark, T.clean_text("t"), "a b c\x1cd﻿e") == "a b c d﻿e"


def test_bullets_f3(spark):
    text = ("We are looking for a talented engineer.\n- Develop new features\n- Write clean, maintainable code\n"
            "- Collaborate with cross-functional teams\n- Participate in code reviews")
    got = one(spark, T.bullets_base("t"), text)
    assert got == py_bullets(text)
    assert got == ["We are looking for a talented engineer.", "Develop new features", "Write clean, maintainable code",
                   "Collaborate with cross", "functional teams", "Participate in code reviews"]


def test_bullets_sentence_fallback_appends(spark):
    text = "A single sentence that is long enough."
    assert one(spark, T.bullets_base("t"), text) == [text, text]


def test_bullet_variants_f23(spark):
    assert one(spark, T.bullets_engine("t"), "short text 14c") == []
    assert one(spark, T.bullets_engine("t"), "first item here • second item here") == ["first item here", "second item here"]
    assert one(spark, T.bullets_ext("t"), "x" * 19) == []
    assert one(spark, T.bullets_ext("t"), "<li>first long bullet line</li><li>and</li><li>second long bullet line</li>") == [
        "first long bullet line", "second long bullet line"]
    many = "\n".join(f"bullet number {i} is long" for i in range(120))
    assert len(one(spark, T.bullets_ext("t"), many)) == 100
    assert len(one(spark, T.bullets_base("t"), many)) == 50


def test_twin_check_documents(spark):
    """Column rules vs their pure-Python statements on real documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("text", T.bullets_base("text").alias("b"), T.fingerprint("text").alias("fp"), T.clean_text("text").alias("c")).collect()
    for r in rows:
        assert r["b"] == py_bullets(r["text"])
        assert r["fp"] == py_fp(r["text"])
        assert r["c"] == py_clean(r["text"])


def test_fingerprint_f7(spark):
    df = spark.createDataFrame([("Hello World",), ("Hello  World  ",)], "t string")
    a, b = [r[0] for r in df.select(T.fingerprint("t")).collect()]
    assert a == b == "hello world"


def test_experience(spark):
    assert one(spark, T.experience("t"), "Exp 2 to 5 Yrs, Pune") == "2 to 5 Yrs"
    assert one(spark, T.experience("t"), "10 Yrs") == "10 Yrs"
    assert one(spark, T.experience("t"), "3 Yrs") == ""
    assert one(spark, T.experience("t"), "0-5 yrs") == "0-5 Yrs"


def test_location_priority(spark):
    assert one(spark, T.location_lookup("t"), "Remote / Bangalore / Bengaluru") == "Bengaluru"
    assert one(spark, T.location_lookup("t"), "work from home in india") == "Work From Home"
    assert one(spark, T.location_lookup("t"), "Work From Home, India") == "Work From Home"
    assert one(spark, T.location_lookup("t"), "nowhere") == ""


def test_skills(spark):
    assert one(spark, T.skills_tag("t"), "") == K.SKILLS_DEFAULT_EMPTY_TEXT
    assert one(spark, T.skills_tag("t"), "nothing here") == K.SKILLS_DEFAULT_NONE_FOUND
    # substring semantics: "Go" hits "good", "Java" hits "JavaScript"
    assert one(spark, T.skills_tag("t"), "good JavaScript and Docker") == ["JavaScript", "Docker", "Java", "Go"]


def test_looks_like_company_f24(spark):
    df = spark.createDataFrame([("Acme Ltd",), ("Manager",), ("Home",), ("acme corp",), ("Blue Ocean",), ("Ab",)], "t string")
    got = [r[0] for r in df.select(T.looks_like_company("t")).collect()]
    assert got == [True, True, False, False, True, False]


def test_smart_trim(spark):
    t = "Header junk here. Job Description: Build things with care and attention.\nSimilar Jobs\nmore"
    assert one(spark, T.smart_trim("t"), t) == ": Build things with care and attention."
    assert one(spark, T.smart_trim("t"), "short") == "short"
    assert one(spark, T.smart_trim("t"), "x" * 60) == "x" * 60
    assert one(spark, T.smart_trim("t"), "About the role tiny\nFollow us everywhere please and thanks") == ""


def test_labelled_fields(spark):
    t = "Role: X\nEmployment Type: Full Time, Permanent\nDepartment: Engineering - Software\nIndustry Type: IT Services | more"
    assert one(spark, T.employment_type("t"), t) == "Full Time, Permanent"
    assert one(spark, T.department("t"), t) == "Engineering - Software"
    assert one(spark, T.industry("t"), t) == "IT Services"


def test_slug_snippet(spark):
    assert one(spark, T.slug("t", "scraped"), "  Acme, Inc. ") == "acme_inc"
    assert one(spark, T.slug("t", "scraped"), "***") == "scraped"
    assert one(spark, T.snippet("t"), "a" * 220) == "a" * 220
    assert one(spark, T.snippet("t"), "a" * 221) == "a" * 220 + "..."


def test_export_helpers(spark):
    df = spark.createDataFrame([("", ["x", "y"], "R", "C"), ("", [], "R", "C"), ("D", [], "R", "C")], "d string, b array<string>, r string, c string")
    got = [x[0] for x in df.select(T.export_description(F.col("d"), F.col("b"), F.col("r"), F.col("c"))).collect()]
    assert got == ["x\ny", "R position at C.", "D"]
    assert one(spark, T.split_skills("t"), " a, ,b ,") == ["a", "b"]


def test_trims_and_splits_equal_their_plain_patterns(spark):
    import random
    import re

    r = random.Random(3)
    some = [*T.PY_WS_CHARS, *T.JS_WS_CHARS, "\x85", "a", "Bc", "ä", "日", "😀", ".", "•", "·", "-", "–", "1.", "٣)", "\n\n", "x y z", "9", "<b>"]
    rows = [("".join(r.choice(some) for _ in range(r.randint(0, 12))),) for _ in range(1500)] + [(None,), ("",), ("a \x85",), (" \x85",), ("a\r\n",)]
    df = spark.createDataFrame(rows, "t string")
    plain = lambda p: p.removeprefix(T.NO_SPLIT)
    ends = lambda ws: F.regexp_replace("t", f"^{ws}+|{ws}+$", "")
    pairs = [
        (T.py_strip("t"), ends(T.WS)), (F.expr(T.strip_sql("t")), ends(T.WS)), (T.js_trim("t"), ends(T.JWS)), (F.expr(T.js_trim_sql("t")), ends(T.JWS)),
        (T.clean_text("t"), F.trim(F.regexp_replace(T.nz("t"), f"{T.WS}+", " "))), (F.expr(T.clean_sql("t")), T.clean_text("t")),
        (T.js_clean("t"), F.trim(F.regexp_replace(T.nz("t"), f"{T.JWS}+", " "))),
        *[(F.split("t", p, -1), F.split("t", plain(p), -1)) for p in (T.BASE_SPLIT, T.ENGINE_SPLIT, T.EXT_SPLIT)],
    ]
    assert all(re.match(r"\(\?!", p) for p in (T.BASE_SPLIT, T.ENGINE_SPLIT, T.EXT_SPLIT))
    for i, (quick, slow) in enumerate(pairs):
        assert df.where(~quick.eqNullSafe(slow)).count() == 0, i


def test_sql_functions_lower_a_text_once_per_rule(spark):
    from jobsift.functions.sql import FUNCTIONS, register_sql_functions

    register_sql_functions(spark)
    plan = spark.sql(
        "SELECT jobsift_skills(t) AS a, jobsift_location(t) AS b, jobsift_looks_like_company(t) AS c FROM VALUES ('x') AS v(t)"
    )._jdf.queryExecution().analyzed().toString()
    assert "instr(lower(" not in plan and "instr(regexp_replace(lower(" not in plan  # not once per word of a list
    assert FUNCTIONS["jobsift_bullets"][2].count(T.sql_re(T.BASE_SPLIT)) == 1
