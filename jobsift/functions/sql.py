"""SQL UDFs (O-E4): the scalar rules as ``CREATE TEMPORARY FUNCTION … RETURN`` bodies.

They are SQL expressions, so Catalyst inlines them into the calling
projection (no Python, whole-stage codegen applies).  Usable from
``spark.sql`` after :func:`register_sql_functions`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as K
from . import text as T


def _re(pattern: str) -> str:
    """A Java regex as a Spark SQL string literal (backslashes escaped)."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"



def _texts(values: list[str]) -> str:
    return "array(" + ", ".join(_re(v) for v in values) + ")"


def _js_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, {_re(T.JWS_RUNS)}, ' '))"


def _pieces(x: str, pattern: str, longer: int, clean=T.clean_sql) -> str:
    """The cleaned pieces of a split text that have more than so many characters."""
    return f"filter(transform(split({x}, {_re(pattern)}, -1), x -> {clean('x')}), x -> length(x) > {longer})"


_T = "coalesce(t, '')"
_NO_TEXTS = "cast(array() AS ARRAY<STRING>)"
_STOP = _re("(?i)^(" + "|".join(K.EXT_STOP_WORDS) + ")$")
_let = T.let_sql  # what a rule uses more than once, or for each word of a list, is worked out once per text

FUNCTIONS = {
    "jobsift_clean_text": ("t STRING", "STRING", T.clean_sql("t")),
    "jobsift_fingerprint": (
        "t STRING", "STRING",
        f"substring(regexp_replace({T.strip_sql(f'lower({_T})')}, {_re(T.WS_RUNS)}, ' '), 1, 100)",
    ),
    "jobsift_slug": (
        "t STRING, dflt STRING", "STRING",
        "coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(t, '')), '[^a-zA-Z0-9]+', '_'), '^_+|_+$', ''), ''), dflt)",
    ),
    "jobsift_snippet": ("t STRING", "STRING", "concat(substring(coalesce(t, ''), 1, 220), if(length(coalesce(t, '')) > 220, '...', ''))"),
    "jobsift_detect_source": (
        "url STRING", "STRING",
        "CASE WHEN instr(lower(coalesce(url, '')), 'indeed.com') > 0 THEN 'Indeed' "
        "WHEN instr(lower(coalesce(url, '')), 'linkedin.com') > 0 AND instr(lower(coalesce(url, '')), 'jobs') > 0 THEN 'LinkedIn' "
        "WHEN instr(lower(coalesce(url, '')), 'naukri.com') > 0 THEN 'Naukri' ELSE 'Generic' END",
    ),
    "jobsift_is_valid_url": ("url STRING", "BOOLEAN", "startswith(coalesce(url, ''), 'http://') OR startswith(coalesce(url, ''), 'https://')"),
    "jobsift_bullets": (
        "t STRING", "ARRAY<STRING>",
        f"CASE WHEN {_T} = '' THEN {_NO_TEXTS} ELSE "
        + _let(_pieces(_T, T.BASE_SPLIT, 10), "p", f"slice(if(size(p) < 2, concat(p, {_pieces(_T, T.SENTENCE_SPLIT, 15)}), p), 1, 50)") + " END",
    ),
    "jobsift_engine_bullets": (
        "t STRING", "ARRAY<STRING>", f"CASE WHEN length({_T}) < 15 THEN {_NO_TEXTS} ELSE slice({_pieces(_T, T.ENGINE_SPLIT, 10)}, 1, 50) END",
    ),
    "jobsift_extension_bullets": (
        "t STRING", "ARRAY<STRING>",
        f"CASE WHEN length({_T}) < 20 THEN {_NO_TEXTS} ELSE slice(filter("
        + _pieces(f"regexp_replace({_T}, '<[^>]*>', chr(10))", T.EXT_SPLIT, 15, _js_clean)
        + f", x -> NOT x RLIKE {_STOP}), 1, 100) END",
    ),
    "jobsift_skills": (
        "t STRING", "ARRAY<STRING>",
        f"CASE WHEN {_T} = '' THEN {_texts(K.SKILLS_DEFAULT_EMPTY_TEXT)} ELSE "
        + _let(_let(f"lower({_T})", "low", f"filter({_texts(K.SKILLS_REF)}, s -> instr(low, lower(s)) > 0)"), "found",
               f"if(size(found) = 0, {_texts(K.SKILLS_DEFAULT_NONE_FOUND)}, found)") + " END",
    ),
    "jobsift_split_skills": ("t STRING", "ARRAY<STRING>", f"filter(transform(split({_T}, ',', -1), x -> {T.strip_sql('x')}), x -> x <> '')"),
    "jobsift_looks_like_company": (
        "t STRING", "BOOLEAN",
        f"length({_T}) >= 3 AND substring({_T}, 1, 1) = upper(substring({_T}, 1, 1)) AND substring({_T}, 1, 1) <> lower(substring({_T}, 1, 1)) AND "
        + _let(T.strip_sql(f"lower({_T})"), "low", f"exists({_texts(K.COMPANY_SUFFIXES)}, s -> instr(low, s) > 0) OR "
               + _let(f"size(regexp_extract_all({_T}, '([A-Z][a-z]+)', 1))", "caps",
                      f"caps >= 2 OR (caps = 1 AND length({_T}) BETWEEN 4 AND 30 AND NOT array_contains({_texts(K.NON_COMPANY_WORDS)}, low))")),
    ),
    "jobsift_location": (
        "t STRING", "STRING", "coalesce(" + _let(f"lower({_T})", "low", f"get(filter({_texts(K.PLACES)}, p -> instr(low, lower(p)) > 0), 0)") + ", '')",
    ),
    "jobsift_experience": (
        "t STRING", "STRING",
        f"if({_T} RLIKE {_re(T.EXPERIENCE_RE)}, concat({T.strip_sql(f'regexp_extract({_T}, {_re(T.EXPERIENCE_RE)}, 1)')}, ' Yrs'), '')",
    ),
    "jobsift_csv_field": ("t STRING", "STRING", f"if({_T} RLIKE {_re('[' + chr(34) + ',' + chr(92) + 'r' + chr(92) + 'n]')}, concat('\"', replace({_T}, '\"', '\"\"'), '\"'), {_T})"),
    "jobsift_url_domain_is": ("url STRING, domain STRING", "BOOLEAN", "instr(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), domain) > 0"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (params, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
