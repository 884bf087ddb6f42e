"""DuckDB SQL of the queries in :mod:`.detail_queries`."""

from __future__ import annotations

from .. import constants as K
from . import oracle as O

_DESC = (
    "'Build ' || lower(p_type) || ' products for the ' || p_brand || ' line. Own size ' || CAST(p_size AS VARCHAR) "
    "|| ' assemblies end to end Work with the ' || nation || ' team every week'"
)
_PARTS = [
    "'Build ' || lower(p_type) || ' products for the ' || p_brand || ' line.'", "'Own size ' || CAST(p_size AS VARCHAR) || ' assemblies end to end'",
    "'Work with the ' || nation || ' team every week'",
]


def _single(company: str, text: str, source: str) -> str:
    return (
        "SELECT page_id, CAST(1 AS INTEGER) AS pos, CASE WHEN c = '' THEN " + O.lit(company) + " ELSE c END AS company, "
        f"CASE WHEN t = '' THEN {O.lit(K.DEFAULT_ROLE_ENGINEER)} ELSE t END AS job_role, CASE WHEN d = '' THEN {O.lit(text)} ELSE d END AS description, "
        f"array_to_string(CASE WHEN d = '' THEN []::VARCHAR[] WHEN len(b) > 0 THEN b ELSE [d] END, chr(10)) AS description_bullets, {O.lit(source)} AS source FROM ("
        f"SELECT *, {O.bullets_base('d')} AS b FROM (SELECT CAST(job_id AS BIGINT) AS page_id, CASE WHEN p_type = 'SMALL' THEN '' ELSE {O.clean('company')} END AS c, "
        f"CASE WHEN p_size % 5 IN (1, 2, 3) THEN {O.clean('role')} ELSE '' END AS t, CASE WHEN p_size % 3 < 2 THEN {_DESC} ELSE '' END AS d FROM ({O.LISTING_JOBS}))) "
        "WHERE c <> '' OR t <> '' OR d <> ''"
    )


def _choice(c: str, fb: str) -> str:
    trimmed = O.smart_trim(fb)
    return (
        f"CASE WHEN length({c}) > 50 AND length({c}) >= length({fb}) * 0.8 THEN {c} WHEN length({fb}) >= 30 THEN "
        f"CASE WHEN length({trimmed}) >= 30 THEN {trimmed} ELSE {fb} END WHEN {c} <> '' THEN {c} ELSE {fb} END"
    )


def _split(x: str) -> str:
    return f"list_filter(list_transform(string_split({O.nz(x)}, ','), lambda x: {O.py_strip('x')}), lambda x: x <> '')"


def _csv(x: str) -> str:
    return f"CASE WHEN regexp_matches({O.nz(x)}, '[\",\\r\\n]') THEN '\"' || replace({O.nz(x)}, '\"', '\"\"') || '\"' ELSE {O.nz(x)} END"


_SKILLS = "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN ' , ,' ELSE lower(p_type) || ',  ' || p_brand || ' ,,size ' || CAST(p_size AS VARCHAR) END"
_LINES = lambda x: f"array_to_string(list_transform({x}, lambda s: '• ' || s), chr(10))"
_KEPT = r"regexp_replace(x, '[^\p{L}\p{N} _-]', '', 'g')"
_join = lambda x: f"array_to_string({x}, '|')"

DETAIL_SQL = {
    "indeed_single": _single(K.INDEED_SINGLE_COMPANY, K.INDEED_SINGLE_DESCRIPTION, "Indeed"),
    "linkedin_single": _single(K.LINKEDIN_SINGLE_COMPANY, K.LINKEDIN_SINGLE_DESCRIPTION, "LinkedIn"),
    "page_body_text": (
        f"SELECT CAST(job_id AS BIGINT) AS page_id, 'Home / Jobs' || chr(10) || {_PARTS[0]} || chr(10) || {_PARTS[1]} AS main_text, "
        f"{_PARTS[0]} || chr(10) || {_PARTS[1]} || chr(10) || {_PARTS[2]} AS body_text FROM ({O.LISTING_JOBS})"
    ),
    "description_choice": (
        f"SELECT doc_id, {_choice('c', 'f')} AS description FROM (SELECT doc_id, CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN substring(t, 1, 40) "
        f"WHEN n % 4 = 2 THEN substring(t, 1, n // 2) ELSE t END AS c, coalesce(CASE WHEN lang = 'de' THEN substring(t, 1, 20) ELSE x END, '') AS f FROM "
        f"(SELECT doc_id, lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {O.TRIM_INPUT} AS x FROM documents))"
    ),
    "skills_split": f"SELECT doc_id, {_join(_split('text'))} AS skills, CAST(len({_split('text')}) AS INTEGER) AS n FROM documents",
    "export_skills_text": (
        f"SELECT CAST(job_id AS BIGINT) AS page_id, CASE WHEN len(s) > 0 THEN {_LINES('s')} ELSE {_LINES(O.skills_tag('d'))} END AS sheet_skills, "
        f"CASE WHEN len(s) > 0 THEN {_LINES('s')} ELSE '• N/A' END AS engine_skills FROM (SELECT job_id, {_split('k')} AS s, d FROM "
        f"(SELECT job_id, {_SKILLS} AS k, {O.DESC} AS d FROM ({O.LISTING_JOBS})))"
    ),
    "csv_fields": f"SELECT doc_id, {_csv('text')} AS text_field, {_csv('source')} AS source_field FROM documents",
    "output_names": (
        "SELECT n_nationkey, CASE WHEN s = '' THEN 'jobs_scraped_' ELSE 'jobs_' || s || '_' END || strftime(ended, '%Y%m%d_%H%M%S') AS name FROM ("
        f"SELECT n_nationkey, ended, {O.py_strip(_KEPT)} AS s FROM ("
        "SELECT n_nationkey, max(o_orderdate) AS ended, any_value(CASE WHEN n_nationkey = 0 THEN ' ,;' ELSE r_name || ', ' || n_name || '/x-y' END) AS x "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey))"
    ),
    "export_report": (
        f"SELECT n_name AS source, coalesce(n, 0) AS rows, coalesce(n, 0) > 0 AS written FROM (SELECT DISTINCT n_name FROM nation) LEFT JOIN "
        f"(SELECT nation, count(*) AS n FROM ({O.LISTING_JOBS}) WHERE p_size >= 49 GROUP BY nation) ON nation = n_name"
    ),
    "sql_text_functions": (
        f"SELECT doc_id, {_join(O.bullets_base('t'))} AS bullets, {_join(O.bullets_engine('t'))} AS engine_bullets, {_join(O.bullets_ext('t'))} AS extension_bullets, "
        f"{_join(O.skills_tag('t'))} AS skills, {O.looks_like_company('l')} AS is_company, {O.location_lookup('t')} AS location, {O.experience('t')} AS experience, "
        f"{_join(_split('t'))} AS split_skills, {_csv('t')} AS csv_field, true AS is_naukri "
        f"FROM (SELECT doc_id, coalesce(text, '') AS t, {O.clean('text')} AS l FROM documents)"
    ),
}
