"""DuckDB SQL equal to each registered query (the correctness oracle).

The SQL is written independently of the Spark code (plain joins, windows,
list lambdas and RE2 regexes over the same parquet tables).  Helpers below
only build repeated SQL fragments from the fixed constants.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.text import BASE_SPLIT, ENGINE_SPLIT, EXT_SPLIT  # noqa: F401  (documented equivalents)

WS = K.PY_WS_RE2
JWS = K.JS_WS_RE2
ND = "\\p{Nd}"


def lit(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)``."""
    parts = s.split("\n")
    q = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(q) if len(q) > 1 else q[0]


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def nz(x: str) -> str:
    return f"coalesce({x}, '')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({nz(x)}, '{WS}+', ' ', 'g'))"


def js_clean(x: str) -> str:
    return f"trim(regexp_replace({nz(x)}, '{JWS}+', ' ', 'g'))"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{JWS}+|{JWS}+$', '', 'g')"


def fp(x: str) -> str:
    return f"substring(regexp_replace({py_strip(f'lower({nz(x)})')}, '{WS}+', ' ', 'g'), 1, 100)"


BASE_SPLIT_RE2 = f"[{K.BULLET_CHARS_BASE}]{WS}*|\\n+|(?:{ND}+[.)]){WS}*"
ENGINE_SPLIT_RE2 = f"[{K.BULLET_CHARS_ENGINE}]{WS}*|[\\n\\r]+|(?:{ND}+[.)]){WS}*"
EXT_SPLIT_RE2 = f"[{K.BULLET_CHARS_EXT}]|\\n+|(?:[0-9]+[.)]){JWS}*"


def bullets_base(t: str) -> str:
    pieces = f"list_filter(list_transform(regexp_split_to_array({t}, '{BASE_SPLIT_RE2}'), lambda x: {clean('x')}), lambda x: length(x) > 10)"
    sents = (
        f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda x: {clean('x')}), lambda x: length(x) > 15)"
    )
    return (
        f"(CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN len({pieces}) < 2 THEN list_concat({pieces}, {sents}) "
        f"ELSE {pieces} END)[1:50]"
    )


def bullets_engine(t: str) -> str:
    pieces = f"list_filter(list_transform(regexp_split_to_array({t}, '{ENGINE_SPLIT_RE2}'), lambda x: {clean('x')}), lambda x: length(x) > 10)"
    return f"(CASE WHEN length({t}) < 15 THEN []::VARCHAR[] ELSE {pieces} END)[1:50]"


def bullets_ext(t: str) -> str:
    stop = "(?i)^(" + "|".join(K.EXT_STOP_WORDS) + ")$"
    cleaned = f"regexp_replace({t}, '<[^>]*>', chr(10), 'g')"
    pieces = (
        f"list_filter(list_transform(regexp_split_to_array({cleaned}, '{EXT_SPLIT_RE2}'), lambda x: {js_clean('x')}), "
        f"lambda x: length(x) > 15 AND NOT regexp_matches(x, '{stop}'))"
    )
    return f"(CASE WHEN length({t}) < 20 THEN []::VARCHAR[] ELSE {pieces} END)[1:100]"


def exploded(table_sql: str, key: str, arr: str, name: str) -> str:
    return (
        f"SELECT {key}, CAST(unnest(generate_series(1, len(arr))) AS INTEGER) AS pos, unnest(arr) AS {name} "
        f"FROM (SELECT {key}, {arr} AS arr FROM {table_sql})"
    )


def skills_tag(t: str) -> str:
    found = f"list_filter({lst(K.SKILLS_REF)}, lambda s: contains(lower({nz(t)}), lower(s)))"
    return (
        f"CASE WHEN {nz(t)} = '' THEN {lst(K.SKILLS_DEFAULT_EMPTY_TEXT)} WHEN len({found}) = 0 THEN "
        f"{lst(K.SKILLS_DEFAULT_NONE_FOUND)} ELSE {found} END"
    )


def looks_like_company(t: str) -> str:
    low = py_strip(f"lower({nz(t)})")
    first = f"substring({nz(t)}, 1, 1)"
    caps = f"len(regexp_extract_all({nz(t)}, '([A-Z][a-z]+)', 1))"
    suffix = f"len(list_filter({lst(K.COMPANY_SUFFIXES)}, lambda s: contains({low}, s))) > 0"
    single = f"({caps} = 1 AND length({nz(t)}) BETWEEN 4 AND 30 AND NOT list_contains({lst(K.NON_COMPANY_WORDS)}, {low}))"
    return (
        f"(length({nz(t)}) >= 3 AND {first} = upper({first}) AND {first} <> lower({first}) "
        f"AND ({suffix} OR {caps} >= 2 OR {single}))"
    )


def location_lookup(t: str) -> str:
    return f"coalesce(list_filter({lst(K.PLACES)}, lambda p: contains(lower({nz(t)}), lower(p)))[1], '')"


EXPERIENCE_RE2 = f"(?i)({ND}+[-{WS[1:-1]}]to{WS}*{ND}+|{ND}+[-{WS[1:-1]}]*{ND}+){WS}*Yrs?"


def experience(t: str) -> str:
    return f"CASE WHEN regexp_matches({nz(t)}, '{EXPERIENCE_RE2}') THEN regexp_extract({nz(t)}, '{EXPERIENCE_RE2}', 1) || ' Yrs' ELSE '' END"


def smart_trim(t: str) -> str:
    starts, ends = lst(K.START_MARKERS), lst(K.END_MARKERS)
    p = f"list_min(list_filter(list_transform({starts}, lambda m: instr({t}, m)), lambda i: i > 0))"
    marker = f"list_filter({starts}, lambda m: instr({t}, m) = {p})[1]"
    a = f"(CASE WHEN {p} IS NULL THEN {t} ELSE {js_trim(f'substring({t}, {p} + length({marker}))')} END)"
    e = f"list_min(list_filter(list_transform({ends}, lambda m: instr({a}, m)), lambda i: i > 0))"
    r = js_trim(f"substring({a}, 1, coalesce({e}, length({a}) + 1) - 1)")
    return f"CASE WHEN {t} IS NULL OR length({t}) < 50 THEN {t} WHEN length({r}) < 30 THEN '' ELSE {r} END"


TERM = "(?:\\n|•|·|\\||\\z)"
EMPLOYMENT_RE2 = f"(?i)(?:Employment|Job){JWS}*Type{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},/&-]+?){TERM}"
DEPARTMENT_RE2 = f"(?i)Department{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},&/-]+?){TERM}"
INDUSTRY_RE2 = f"(?i)Industry{JWS}*(?:Type)?{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},&/-]+?){TERM}"


def labelled(t: str, pattern: str) -> str:
    head = f"substring({nz(t)}, 1, 20000)"
    return f"CASE WHEN regexp_matches({head}, '{pattern}') THEN {js_trim(f'regexp_extract({head}, {lit(pattern)}, 1)')} ELSE '' END"


def slug(x: str, default: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({nz(x)}), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN {lit(default)} ELSE {s} END"


def snippet(x: str, n: int = 220) -> str:
    return f"substring({nz(x)}, 1, {n}) || CASE WHEN length({nz(x)}) > {n} THEN '...' ELSE '' END"


def first_per_key(inner: str, key: str, order: str, cols: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn FROM ({inner})) WHERE _rn = 1"


def description_key(desc: str, company: str) -> str:
    return f"CASE WHEN {nz(desc)} <> '' THEN {fp(f'substring({desc}, 1, 100)')} ELSE {fp(company)} END"


TRIM_INPUT = "'Header ' || source || chr(10) || 'Job Description: ' || coalesce(text, '') || chr(10) || 'Similar Jobs' || chr(10) || lang"
LABELLED_INPUT = (
    "'Employment Type: ' || source || chr(10) || 'Department: ' || lang || ' • x' || chr(10) || coalesce(text, '') "
    "|| chr(10) || 'Industry Type: ' || upper(lang)"
)

PRIMARY_SUPPLIER_JOBS = (
    "SELECT p.p_partkey AS job_id, s.s_name AS company, p.p_type AS job_role FROM part p "
    "JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier) + 1"
)

TEXT_SQL = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "bullets_base": exploded("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "doc_id", bullets_base("t"), "bullet"),
    "bullets_engine": exploded("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "doc_id", bullets_engine("t"), "bullet"),
    "bullets_ext": exploded("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "doc_id", bullets_ext("t"), "bullet"),
    "fingerprint": f"SELECT doc_id, {fp('text')} AS fp FROM documents",
    "dedup_description": first_per_key(
        f"SELECT doc_id, {description_key('description', 'company')} AS fp FROM "
        f"(SELECT doc_id, source AS company, {py_strip(nz('text'))} AS description FROM documents)",
        "fp", "doc_id", "doc_id, fp",
    ),
    "dedup_role_company": first_per_key(
        f"SELECT *, {fp('coalesce(job_role, \'\') || coalesce(company, \'\')')} AS fp FROM ({PRIMARY_SUPPLIER_JOBS})",
        "fp", "job_id", "job_id, company, job_role",
    ),
    "dedup_triple": first_per_key(
        "SELECT doc_id, concat_ws('|', coalesce(source, ''), coalesce(lang, ''), substring(coalesce(text, ''), 1, 100)) AS k FROM documents",
        "k", "doc_id", "doc_id",
    ),
    "dedup_cross_run": (
        f"WITH d AS (SELECT doc_id, source, {description_key('description', 'source')} AS fp FROM "
        f"(SELECT doc_id, source, {py_strip(nz('text'))} AS description FROM documents)) "
        + first_per_key("SELECT * FROM d WHERE source >= 'src5' AND fp NOT IN (SELECT fp FROM d WHERE source < 'src5')", "fp", "doc_id", "doc_id, fp")
    ),
    "skills_tag": f"SELECT doc_id, array_to_string({skills_tag('text')}, '|') AS skills FROM documents",
    "looks_like_company": (
        f"SELECT id, probe, {looks_like_company('probe')} AS is_company FROM ("
        "SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS probe FROM supplier UNION ALL "
        f"SELECT 'd' || CAST(doc_id AS VARCHAR) || '.' || CAST(i AS VARCHAR) AS id, {clean('x[i]')} AS probe FROM "
        "(SELECT doc_id, x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"
    ),
    "location_lookup": f"SELECT doc_id, {location_lookup('text')} AS location FROM documents",
    "experience": f"SELECT doc_id, {experience('text')} AS experience FROM documents",
    "smart_trim": (
        f"SELECT doc_id, {smart_trim('t')} AS trimmed, {smart_trim('text')} AS trimmed_raw "
        f"FROM (SELECT doc_id, text, {TRIM_INPUT} AS t FROM documents)"
    ),
    "labelled_fields": (
        f"SELECT doc_id, {labelled('t', EMPLOYMENT_RE2)} AS employment_type, {labelled('t', DEPARTMENT_RE2)} AS department, "
        f"{labelled('t', INDUSTRY_RE2)} AS industry FROM (SELECT doc_id, {LABELLED_INPUT} AS t FROM documents)"
    ),
    "slug_snippet": (
        f"SELECT doc_id, {slug('source', 'scraped')} AS company_slug, {slug('text', 'job')} AS role_slug, "
        f"{snippet('text')} AS snippet FROM documents"
    ),
}


# ---------------------------------------------------------------------------
# pages
# ---------------------------------------------------------------------------
def decode(x: str) -> str:
    """The four entities present in the supplied pages, ``&amp;`` last."""
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def source_sql(u: str) -> str:
    lu = f"lower({nz(u)})"
    return (
        f"CASE WHEN contains({lu}, 'indeed.com') THEN 'Indeed' WHEN contains({lu}, 'linkedin.com') AND contains({lu}, 'jobs') "
        f"THEN 'LinkedIn' WHEN contains({lu}, 'naukri.com') THEN 'Naukri' ELSE 'Generic' END"
    )


HOST = "regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def page_url_sql(u: str, s: str) -> str:
    return (
        f"CASE WHEN page_no = 0 THEN {u} "
        f"WHEN contains({u}, 'start=') THEN regexp_replace({u}, 'start={ND}+', 'start=' || CAST(page_no * 10 AS VARCHAR), 'g') "
        f"WHEN contains({u}, 'page=') THEN regexp_replace({u}, 'page={ND}+', 'page=' || CAST(page_no + 1 AS VARCHAR), 'g') "
        f"WHEN {s} = 'Indeed' THEN {u} || CASE WHEN contains({u}, '?') THEN '&' ELSE '?' END || 'start=' || CAST(page_no * 10 AS VARCHAR) END"
    )


USABLE_PAGES = "(SELECT * FROM pages WHERE html IS NOT NULL)"
PAGE_LINKS = (
    "SELECT page_id, CAST(unnest(generate_series(1, len(h))) AS INTEGER) AS pos, unnest(h) AS href, unnest(t) AS link_text FROM ("
    f"SELECT page_id, list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), lambda x: {decode('x')}) AS h, "
    f"list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: {decode('x')}) AS t FROM {USABLE_PAGES})"
)
LINK_PATTERN = (
    "CASE WHEN contains(href, '/job-listings') THEN 'job-listings' WHEN contains(href, '/ai-jobs') OR ends_with(href, '-jobs') "
    "THEN 'filter-jobs' WHEN contains(lower(href), 'company') THEN 'company' WHEN length(href) > 5 AND starts_with(href, '/') "
    "THEN 'other' END"
)


_SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_DIR = f"{_SITE} || coalesce(nullif(regexp_extract({_PATH}, '^.*/'), ''), '/')"
_UP = f"{_SITE} || regexp_replace(coalesce(nullif(regexp_extract({_PATH}, '^.*/'), ''), '/'), '[^/]+/$', '')"
RESOLVED = [  # one expression per form of plans.page_queries.LINK_FORMS
    f"{_SITE} || '/' || x", f"{_DIR} || x", f"{_UP} || x", f"{_SITE} || {_PATH} || '?' || x",
    "regexp_extract(url, '^[^#]*') || '#' || x", "'mailto:' || x", "regexp_extract(url, '^[a-z]+:') || '//other.example.com/' || x",
    f"{_DIR} || x", "regexp_extract(url, '^[^#]*')", "'https://other.example.com/b/' || x",
]
RESOLVE_LINKS = (
    "SELECT page_id, pos, CAST(form - 1 AS INTEGER) AS form, CASE form "
    + " ".join(f"WHEN {i + 1} THEN {e}" for i, e in enumerate(RESOLVED))
    + f" END AS resolved FROM (SELECT l.page_id, pos, url, regexp_replace(href, '^/', '') AS x, unnest(range(1, {len(RESOLVED) + 1})) AS form "
    f"FROM ({PAGE_LINKS}) l JOIN pages USING (page_id))"
)


def first_tag_text(tag: str) -> str:
    inner = f"regexp_extract(html, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    return clean(decode(f"regexp_replace({inner}, '<[^>]*>', '', 'g')"))


JOB_LINK_COUNT = (
    "len(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: contains(h, '/job') OR contains(h, '/career') "
    "OR contains(h, '/position') OR contains(h, '/vacancy')))"
)
GENERIC_IS_JOB = (
    "((regexp_matches(html, '<h1[\\s>]') OR regexp_matches(html, '<h2[^>]*class=\"[^\"]*title')) AND "
    "(regexp_matches(html, 'class=\"[^\"]*description') OR regexp_matches(html, 'class=\"[^\"]*job-detail') "
    "OR regexp_matches(html, 'id=\"jobDescriptionText\"')))"
)

PAGE_SQL = {
    "url_source": (
        f"SELECT page_id, {source_sql('url')} AS source, (starts_with(coalesce(url, ''), 'http://') OR starts_with(coalesce(url, ''), 'https://')) AS valid, "
        "(url IS NOT NULL AND url <> '' AND NOT starts_with(url, 'chrome://') AND NOT starts_with(url, 'edge://') AND NOT starts_with(url, 'about:')) AS batch_ok, "
        "NOT contains(lower(coalesce(url, '')), 'indeed.com') AS indeed_mismatch FROM pages"
    ),
    "url_domain": (
        f"SELECT page_id, {HOST} AS host, contains(lower({HOST}), 'indeed.com') AS is_indeed, "
        f"contains(lower({HOST}), 'linkedin.com') AS is_linkedin, contains(lower({HOST}), 'naukri.com') AS is_naukri FROM pages"
    ),
    "url_single": (
        "SELECT page_id, (contains(lower(coalesce(url, '')), '/viewjob') OR contains(lower(coalesce(url, '')), 'jk=') "
        "OR contains(lower(coalesce(url, '')), '/rc/clk')) AS indeed_single, (contains(lower(coalesce(url, '')), '/jobs/view') "
        "OR contains(lower(coalesce(url, '')), '/jobs/collections')) AS linkedin_single FROM pages"
    ),
    "pagination": (
        "SELECT * FROM (SELECT page_id, CAST(page_no AS INTEGER) AS page_no, "
        f"{page_url_sql('u', 'source')} AS page_url, {page_url_sql('u', chr(39) + 'Indeed' + chr(39))} AS indeed_url "
        f"FROM (SELECT page_id, coalesce(url, '') AS u, {source_sql('url')} AS source FROM pages) p, range(0, 3) r(page_no)) "
        "WHERE page_url IS NOT NULL OR indeed_url IS NOT NULL"
    ),
    "usable_blocked": (
        "SELECT page_id, (html IS NOT NULL AND length(html) >= 500) AS usable, (contains(lower(html), 'captcha') OR "
        "contains(lower(html), 'verify you are human') OR contains(lower(html), 'blocked')) AS blocked, "
        "(contains(lower(html), 'captcha') OR contains(lower(html), 'verify')) AS blocked_v2 FROM pages"
    ),
    "page_headings": f"SELECT page_id, {first_tag_text('title')} AS title, {first_tag_text('h1')} AS h1 FROM {USABLE_PAGES}",
    "page_links": PAGE_LINKS,
    "resolve_links": RESOLVE_LINKS,
    "link_histogram": (
        f"SELECT pattern, CAST(count(*) AS BIGINT) AS n FROM (SELECT {LINK_PATTERN} AS pattern FROM ({PAGE_LINKS})) "
        "WHERE pattern IS NOT NULL GROUP BY pattern ORDER BY n DESC, pattern"
    ),
    "link_sample": (
        f"SELECT page_id, CAST(rk AS INTEGER) AS rank, {py_strip('substring(link_text, 1, 60)')} AS text60, substring(href, 1, 90) AS href90 "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rk FROM ({PAGE_LINKS}) "
        "WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript')) WHERE rk <= 20"
    ),
    "page_type": (
        f"SELECT page_id, CASE WHEN contains(lower({HOST}), 'naukri.com') THEN 'naukri' ELSE 'generic' END AS site, "
        f"CASE WHEN {GENERIC_IS_JOB} THEN 'job' WHEN {JOB_LINK_COUNT} >= 3 THEN 'listing' ELSE 'unknown' END AS page_type, "
        f"CAST({JOB_LINK_COUNT} AS INTEGER) AS job_links FROM {USABLE_PAGES}"
    ),
}


# ---------------------------------------------------------------------------
# round-trip extraction: expected rows straight from part ⋈ supplier ⋈ nation
# ---------------------------------------------------------------------------
LISTING_JOBS = (
    "SELECT p.p_partkey AS job_id, s.s_suppkey, s.s_name AS company, p.p_name AS role, p.p_type, p.p_brand, p.p_size, "
    "n.n_name AS nation, n.n_regionkey AS region FROM part p JOIN supplier s ON s.s_suppkey = "
    "(SELECT min(s_suppkey) FROM supplier) + p.p_partkey % (SELECT count(*) FROM supplier) "
    "JOIN nation n ON s.s_nationkey = n.n_nationkey"
)
CARD_POS = "CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY job_id) AS INTEGER)"


def dedup_rc(rows: str, cols: str) -> str:
    return first_per_key(f"SELECT *, {fp('job_role || company')} AS fp FROM ({rows})", "fp", "page_id, pos", cols)


def card_site_rows(prefix: str, default_company: str, link: str) -> str:
    return (
        f"SELECT page_id, pos, coalesce(comp, {lit(default_company)}) AS company, job_role, "
        f"{lit(prefix)} || job_role || ' at ' || coalesce(comp, 'company') || '.' AS description, "
        f"'Location: ' || nation AS description_bullets, nation AS location, {link} AS link FROM ("
        f"SELECT CAST(s_suppkey AS BIGINT) AS page_id, {CARD_POS} AS pos, CASE WHEN p_type = 'SMALL' THEN NULL ELSE {clean('company')} END AS comp, "
        f"{clean('role')} AS job_role, {clean('nation')} AS nation, job_id FROM ({LISTING_JOBS}))"
    )


def card_site(prefix: str, default_company: str, link: str) -> str:
    return dedup_rc(card_site_rows(prefix, default_company, link), "page_id, pos, company, job_role, description, description_bullets, location, link")


NAUKRI_PLACE = f"{lst(K.PLACES)}[region + 1]"
NAUKRI_CARD_TEXT = (
    "concat_ws(' ', role, CASE WHEN p_type = 'SMALL' THEN NULL ELSE company END, "
    "CAST(p_size // 10 AS VARCHAR) || '-' || CAST(p_size // 10 + 3 AS VARCHAR) || ' Yrs', "
    f"nation || ', ' || {NAUKRI_PLACE}, p_brand, lower(p_type))"
)
NAUKRI_CARD_ROWS = (
    f"SELECT page_id, pos, company, job_role, description, array_to_string({bullets_engine('description')}, chr(10)) AS description_bullets, "
    f"skills, {location_lookup('all_text')} AS location, {experience('all_text')} AS experience FROM ("
    f"SELECT page_id, pos, all_text, company, job_role, {clean('substring(all_text, 1, 280)')} AS description, skills FROM ("
    f"SELECT CAST(s_suppkey AS BIGINT) AS page_id, 2 * {CARD_POS} - 1 AS pos, "
    f"regexp_replace({NAUKRI_CARD_TEXT}, '{WS}+', ' ', 'g') AS all_text, "
    f"CASE WHEN p_type = 'SMALL' THEN {lit(K.NAUKRI_CARD_COMPANY)} ELSE {clean('company')} END AS company, {clean('role')} AS job_role, "
    f"array_to_string(list_filter([{clean('p_brand || lower(p_type)')}, {clean('p_brand')}, {clean('lower(p_type)')}], lambda x: x <> '')[1:10], chr(10)) AS skills "
    f"FROM ({LISTING_JOBS})))"
)
NAUKRI_SINGLE_ROWS = (
    f"SELECT CAST(s_suppkey AS BIGINT) AS page_id, 1 AS pos, {clean('min(company)')} AS company, {lit(K.NAUKRI_SINGLE_ROLE)} AS job_role, "
    f"{lit(K.NAUKRI_SINGLE_DESCRIPTION)} AS description, '' AS description_bullets, "
    f"string_agg({clean('p_brand')}, chr(10) ORDER BY job_id) AS skills, {lit(K.NAUKRI_SINGLE_LOCATION)} AS location, "
    f"{lit(K.NAUKRI_SINGLE_EXPERIENCE)} AS experience FROM ({LISTING_JOBS}) GROUP BY s_suppkey HAVING bool_or(p_type <> 'SMALL')"
)
NAUKRI_COLS = "page_id, pos, company, job_role, description, description_bullets, skills, location, experience"

EXTRACT_SQL = {
    "extract_indeed": card_site("Job posting for ", K.INDEED_CARD_COMPANY, "'https://www.indeed.com/rc/clk?jk=' || CAST(job_id AS VARCHAR)"),
    "extract_linkedin": card_site("Job posting position for ", K.LINKEDIN_CARD_COMPANY, "'https://www.linkedin.com/jobs/view/' || CAST(job_id AS VARCHAR)"),
    "extract_naukri": dedup_rc(NAUKRI_CARD_ROWS, NAUKRI_COLS),
    "naukri_single": dedup_rc(
        f"{NAUKRI_SINGLE_ROWS} UNION ALL SELECT * FROM ({NAUKRI_CARD_ROWS}) WHERE page_id NOT IN "
        f"(SELECT s_suppkey FROM ({LISTING_JOBS}) GROUP BY s_suppkey HAVING bool_or(p_type <> 'SMALL'))",
        NAUKRI_COLS,
    ),
}


# ---------------------------------------------------------------------------
# generic strategies
# ---------------------------------------------------------------------------
DESC = (
    "'Build ' || lower(p_type) || ' products for the ' || p_brand || ' line. - Own size ' || CAST(p_size AS VARCHAR) "
    "|| ' assemblies end to end - Work with the ' || nation || ' team every week'"
)


def generic_rows(items: str) -> str:
    """items(page_id, pos, company, role, description) → post-processed rows (before dedup)."""
    return (
        f"SELECT page_id, pos, company, CASE WHEN role = '' THEN {lit(K.GENERIC_DEFAULT_ROLE)} ELSE role END AS job_role, description, "
        f"array_to_string(CASE WHEN description = '' THEN []::VARCHAR[] WHEN len(b) > 0 THEN b ELSE [description] END, chr(10)) AS description_bullets "
        f"FROM (SELECT *, CASE WHEN description = '' THEN []::VARCHAR[] ELSE {bullets_base('description')} END AS b FROM ("
        f"SELECT page_id, pos, {py_strip('company')} AS company, {py_strip('role')} AS role, {py_strip('description')} AS description FROM ({items}))) "
        f"WHERE length(company) >= 2 AND lower(company) NOT IN ({', '.join(lit(w) for w in K.GENERIC_REJECTED_COMPANIES)})"
    )


def generic_post(items: str) -> str:
    rows = generic_rows(items)
    return first_per_key(
        f"SELECT *, {description_key('description', 'company')} AS fp FROM ({rows})", "fp", "page_id, pos",
        "page_id, pos, company, job_role, description, description_bullets",
    )


def _items(company: str, role: str, desc: str, where: str = "TRUE", region: str | None = None) -> str:
    reg = "" if region is None else f" AND region {region}"
    return (
        f"SELECT CAST(s_suppkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY job_id) AS INTEGER) AS pos, "
        f"{company} AS company, {role} AS role, {desc} AS description FROM ({LISTING_JOBS}) WHERE {where}{reg}"
    )


JSONLD_ITEMS = lambda reg=None: _items("company", "role", DESC, region=reg)
TABLE_ITEMS = lambda reg=None: _items(clean("company"), clean("role"), clean(DESC), region=reg)
CARD_ITEMS = lambda reg=None: _items(clean("company"), clean("role"), clean(DESC), "p_type <> 'SMALL'", region=reg)
TEXT_ITEMS = lambda reg=None: _items(clean("replace(company, '#', ' ')"), clean("role"), "''", region=reg)

CUSTOM_ITEMS = _items(
    f"CASE WHEN p_size % 3 <> 0 THEN {clean("('Custom ' || company)")} ELSE {clean('company')} END",
    f"CASE WHEN p_size % 2 = 0 THEN {clean("('Custom ' || role)")} ELSE {clean('role')} END",
    f"CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN {clean("('Custom ' || p_brand)")} ELSE {clean(DESC)} END",
    "(p_size % 3 <> 0 OR p_type <> 'SMALL')",
)

GENERIC_SQL = {
    "custom_selectors": generic_post(CUSTOM_ITEMS),
    "extract_jsonld": generic_post(JSONLD_ITEMS()),
    "extract_tables": generic_post(TABLE_ITEMS()),
    "extract_cards": generic_post(CARD_ITEMS()),
    "extract_text_patterns": generic_post(TEXT_ITEMS()),
    "heuristic_cascade": generic_post(
        f"{JSONLD_ITEMS('IN (0, 4)')} UNION ALL {TABLE_ITEMS('= 1')} UNION ALL {CARD_ITEMS('= 2')} UNION ALL {TEXT_ITEMS('= 3')}"
    ),
}


# ---------------------------------------------------------------------------
# reports and exports over the mixed-layout run
# ---------------------------------------------------------------------------
RUN = GENERIC_SQL["heuristic_cascade"]


def bullet_lines_sql(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda x: '• ' || x), chr(10))"


def export_desc(d: str, b: str, role: str, company: str) -> str:
    return f"CASE WHEN {d} <> '' THEN {d} WHEN {b} <> '' THEN {b} ELSE {role} || ' position at ' || {company} || '.' END"


MIXED_FOUND = (
    "SELECT CAST(s_suppkey AS BIGINT) AS page_id, CAST(CASE WHEN min(region) = 2 THEN count(*) FILTER (WHERE p_type <> 'SMALL') "
    f"ELSE count(*) END AS INTEGER) AS total_found FROM ({LISTING_JOBS}) GROUP BY s_suppkey"
)

REPORT_SQL = {
    "summary": (
        "SELECT CAST(count(*) AS BIGINT) AS total_entries, CAST(count(DISTINCT company) AS BIGINT) AS companies, "
        f"CAST(count(DISTINCT job_role) AS BIGINT) AS job_roles, 'Generic' AS sources FROM ({RUN})"
    ),
    "outcomes": (
        "SELECT f.page_id, 'Generic' AS source, coalesce(k.n, 0) > 0 AS success, f.total_found, CAST(coalesce(k.n, 0) AS INTEGER) AS total_new, "
        f"CASE WHEN coalesce(k.n, 0) > 0 THEN '' ELSE {lit('Could not automatically detect company/job data on this page. Try using the ' + chr(39) + 'Custom CSS Selectors' + chr(39) + ' option in Advanced Settings.')} END AS error_message "
        f"FROM ({MIXED_FOUND}) f LEFT JOIN (SELECT page_id, count(*) AS n FROM ({RUN}) GROUP BY page_id) k ON f.page_id = k.page_id"
    ),
    "preview": f"SELECT page_id, pos, company, job_role FROM ({RUN}) ORDER BY page_id, pos LIMIT 10",
    "export_sheet": (
        "SELECT CAST(row_number() OVER (ORDER BY page_id, pos) AS BIGINT) AS s_no, company AS company_name, job_role, "
        "CASE WHEN description_bullets <> '' THEN array_to_string(list_transform(string_split(description_bullets, chr(10)), lambda x: '• ' || x), chr(10)) "
        "WHEN description <> '' THEN '• ' || description ELSE 'No description available' END AS job_description, "
        f"CASE WHEN description <> '' THEN {bullet_lines_sql(skills_tag('description'))} ELSE '• N/A' END AS key_skills, "
        f"'N/A' AS location, 'N/A' AS experience, 'Generic' AS source FROM ({RUN})"
    ),
    "export_csv": (
        "SELECT CAST(row_number() OVER (ORDER BY page_id, pos) AS BIGINT) AS s_no, company AS company_name, job_role, "
        "CASE WHEN description_bullets <> '' THEN array_to_string(list_transform(string_split(description_bullets, chr(10)), lambda x: '• ' || x), chr(10)) "
        "ELSE description END AS job_description, '' AS key_skills, '' AS education, '' AS employment_type, '' AS department, "
        f"'' AS industry, 'Generic' AS source FROM ({RUN})"
    ),
    "export_json": (
        "SELECT id, file_name, company, title, location, url, descriptionSnippet, requiredSkills, fullDescription FROM ("
        "SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id DESC, pos DESC) AS rk FROM ("
        f"SELECT page_id, pos, 'scraped-' || {slug('company', 'scraped')} || '-' || {slug('job_role', 'job')} AS id, "
        f"{slug('company', 'scraped')} || '_' || {slug('job_role', 'job')} || '.json' AS file_name, "
        f"CASE WHEN company = '' THEN {lit(K.JSON_SHEET_COMPANY)} ELSE company END AS company, "
        f"CASE WHEN job_role = '' THEN {lit(K.JSON_SHEET_ROLE)} ELSE job_role END AS title, {lit(K.JSON_LOCATION)} AS location, '#' AS url, "
        f"{snippet('d')} AS descriptionSnippet, array_to_string({skills_tag('d')}, '|') AS requiredSkills, d AS fullDescription FROM ("
        f"SELECT *, {export_desc('description', 'description_bullets', 'job_role', 'company')} AS d FROM ({RUN})))) WHERE rk = 1"
    ),
}


# ---------------------------------------------------------------------------
# extension: links, job pages, enrichment
# ---------------------------------------------------------------------------
def _link_rows(url_prefix: str, company: str, role: str = "role") -> str:
    return (
        f"SELECT CAST(s_suppkey AS BIGINT) AS page_id, {CARD_POS} AS pos, {lit(url_prefix)} || CAST(job_id AS VARCHAR) AS url, "
        f"{company} AS company, {role} AS role FROM ({LISTING_JOBS})"
    )


CARD_COMPANY = "CASE WHEN p_type = 'SMALL' THEN '' ELSE company END"
JOB_DESC = (
    "'Build ' || lower(p_type) || ' products for the ' || p_brand || ' line.' || chr(10) || 'Own size ' || CAST(p_size AS VARCHAR) "
    "|| ' assemblies end to end' || chr(10) || 'Work with the ' || nation || ' team every week'"
)
JOB_PAGE_ROWS = (
    "SELECT CAST(job_id AS BIGINT) AS page_id, 'https://www.naukri.com/job-listings-r-' || CAST(job_id AS VARCHAR) AS url, 'job' AS page_type, "
    f"CASE WHEN p_type = 'LARGE' THEN {lit(K.COMPANY_SENTINEL)} ELSE company END AS company, role AS job_role, d AS description, "
    f"array_to_string({bullets_ext('d')}, chr(10)) AS description_bullets, p_brand || chr(10) || lower(p_type) AS skills, "
    f"nation || ', ' || {NAUKRI_PLACE} AS location, CAST(p_size // 10 AS VARCHAR) || '-' || CAST(p_size // 10 + 3 AS VARCHAR) || ' Yrs' AS experience, "
    "'Graduate - ' || lower(p_type) AS education, 'Full Time, Permanent' AS employment_type, 'Engineering - Hardware' AS department, "
    "upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) || ' Goods' AS industry, '' AS highlights, 'naukri-job-page' AS source "
    f"FROM (SELECT *, {JOB_DESC} AS d FROM ({LISTING_JOBS}))"
)
CRAWLED_JOB_PAGE_ROWS = f"{JOB_PAGE_ROWS} WHERE p_size >= 10"  # the pages that the enrichment batch finds
NAUKRI_LINKS = _link_rows("https://www.naukri.com/job-listings-r-", CARD_COMPANY)
BATCH_JOIN = (
    f"SELECT l.page_id, l.pos, l.url, l.company AS card_company, l.role AS card_role, j.* EXCLUDE (page_id, url) "
    f"FROM ({NAUKRI_LINKS}) l LEFT JOIN ({CRAWLED_JOB_PAGE_ROWS}) j ON l.url = j.url"
)

EXTENSION_SQL = {
    "naukri_links": NAUKRI_LINKS,
    "generic_links": _link_rows("https://careers.example.com/jobs/", CARD_COMPANY),
    "script_links": _link_rows("https://www.naukri.com/job-listings-r-", "''", "substring(role, 1, 120)"),
    "naukri_job_page": (
        "SELECT page_id, page_type, company, job_role, description, description_bullets, skills, location, experience, education, "
        f"employment_type, department, industry, highlights, source FROM ({JOB_PAGE_ROWS})"
    ),
    "script_job_page": (
        "SELECT CAST(job_id AS BIGINT) AS page_id, CASE WHEN p_type = 'LARGE' THEN '[MISSING]' ELSE substring(company, 1, 100) END AS company, "
        f"substring(role, 1, 120) AS role, 0 AS desc_len, p_brand || lower(p_type) AS skills FROM ({LISTING_JOBS})"
    ),
    "enrich_links": (
        "SELECT page_id, pos, url, "
        "CASE WHEN source IS NULL THEN card_company WHEN company <> '' AND NOT starts_with(company, '[COMPANY_') THEN company "
        "WHEN card_company <> '' THEN card_company ELSE company END AS company, "
        "CASE WHEN source IS NULL THEN card_role WHEN job_role <> '' AND NOT starts_with(job_role, '[ROLE_') THEN job_role "
        "WHEN card_role <> '' THEN card_role ELSE job_role END AS job_role, "
        "coalesce(description, '') AS description, coalesce(description_bullets, '') AS description_bullets, coalesce(skills, '') AS skills, "
        "coalesce(education, '') AS education, coalesce(employment_type, '') AS employment_type, coalesce(department, '') AS department, "
        "coalesce(industry, '') AS industry, coalesce(source, 'batch-card-fallback') AS source "
        f"FROM ({BATCH_JOIN}) WHERE source IS NOT NULL OR card_company <> ''"
    ),
    "enrich_errors": f"SELECT page_id, pos, url, 'No data extracted' AS error FROM ({BATCH_JOIN}) WHERE source IS NULL AND card_company = ''",
}


# ---------------------------------------------------------------------------
# streaming, upgrades, multi-source summary, batch status
# ---------------------------------------------------------------------------
UPGRADE_LONGEST = (
    "SELECT url, capture_no FROM (SELECT source AS url, doc_id AS capture_no, row_number() OVER (PARTITION BY source "
    "ORDER BY length(coalesce(text, '')) DESC, doc_id ASC) AS rk FROM documents) WHERE rk = 1"
)
STREAM_SQL = {
    "stream_dedup": (
        f"SELECT DISTINCT {description_key(py_strip(nz('text')), 'source')} AS fp FROM documents"
    ),
    "upgrade_longest": UPGRADE_LONGEST,
    "stream_upgrade": UPGRADE_LONGEST,
    "upgrade_if_short": (
        "SELECT url, capture_no FROM (SELECT source AS url, doc_id AS capture_no, row_number() OVER w AS rk, "
        "first_value(length(coalesce(text, ''))) OVER w AS first_len, count(*) OVER (PARTITION BY source) AS n "
        "FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) "
        "WHERE (rk = 1 AND (first_len > 100 OR n = 1)) OR (rk = 2 AND first_len <= 100)"
    ),
    "sites_summary": (
        "SELECT CAST(count(*) AS BIGINT) AS total_entries, CAST(count(DISTINCT company) AS BIGINT) AS companies, "
        "CAST(count(DISTINCT job_role) AS BIGINT) AS job_roles, 'Indeed, LinkedIn, Naukri' AS sources FROM ("
        f"SELECT company, job_role FROM ({EXTRACT_SQL['extract_indeed']}) UNION ALL "
        f"SELECT company, job_role FROM ({EXTRACT_SQL['extract_linkedin']}) UNION ALL "
        f"SELECT company, job_role FROM ({EXTRACT_SQL['extract_naukri']}))"
    ),
    "batch_status": (
        "SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) AS BIGINT) AS total, "
        "CAST(count(*) FILTER (WHERE source IS NOT NULL OR card_company <> '') AS BIGINT) AS results, "
        "CAST(count(*) FILTER (WHERE source IS NULL AND card_company = '') AS BIGINT) AS errors, "
        f"CAST(CASE WHEN count(*) > 0 THEN 100 ELSE 0 END AS INTEGER) AS percent FROM ({BATCH_JOIN})"
    ),
}

TEXT_SQL["sql_functions"] = (
    f"SELECT doc_id, {clean('text')} AS clean, {fp('text')} AS fp, {slug('source', 'scraped')} AS company_slug, "
    f"{snippet('text')} AS snippet, 'Naukri' AS src FROM documents"
)


# ---------------------------------------------------------------------------
# routed run over a mixed crawl, listing-engine exports
# ---------------------------------------------------------------------------
NAUKRI_APP_ROWS = (
    f"{NAUKRI_SINGLE_ROWS} UNION ALL SELECT * FROM ({NAUKRI_CARD_ROWS}) WHERE page_id NOT IN "
    f"(SELECT s_suppkey FROM ({LISTING_JOBS}) GROUP BY s_suppkey HAVING bool_or(p_type <> 'SMALL'))"
)
MIXED_ITEMS = (
    f"{JSONLD_ITEMS('IN (0, 4)')} UNION ALL {TABLE_ITEMS('= 1')} UNION ALL {CARD_ITEMS('= 2')} UNION ALL {TEXT_ITEMS('= 3')}"
)
ROUTED_ROWS = (
    "SELECT page_id * 4 + 0 AS page_id, pos, 'Indeed' AS source, company, job_role, description, "
    f"'F|' || {fp('job_role || company')} AS k FROM ({card_site_rows('Job posting for ', K.INDEED_CARD_COMPANY, chr(39) + chr(39))}) "
    "UNION ALL SELECT page_id * 4 + 1, pos, 'LinkedIn', company, job_role, description, "
    f"'F|' || {fp('job_role || company')} FROM ({card_site_rows('Job posting position for ', K.LINKEDIN_CARD_COMPANY, chr(39) + chr(39))}) "
    "UNION ALL SELECT page_id * 4 + 2, pos, 'Scrapling-Naukri', company, job_role, description, "
    "'T|' || concat_ws('|', company, job_role, substring(description, 1, 100)) FROM (" + NAUKRI_APP_ROWS + ") "
    "UNION ALL SELECT page_id * 4 + 3, pos, 'Generic', company, job_role, description, "
    f"'F|' || {description_key('description', 'company')} FROM ({generic_rows(MIXED_ITEMS)})"
)
NAUKRI_RUN = dedup_rc(NAUKRI_CARD_ROWS, "page_id, pos, company, job_role, description, description_bullets, skills, location, experience")

ROUTED_SQL = {
    "routed_run": first_per_key(ROUTED_ROWS, "k", "page_id, pos", "CAST(page_id AS BIGINT) AS page_id, pos, source, company, job_role, description"),
    "export_sheet_engine": (
        "SELECT CAST(row_number() OVER (ORDER BY page_id, pos) AS BIGINT) AS s_no, company AS company_name, job_role, "
        "CASE WHEN description_bullets <> '' THEN array_to_string(list_transform(string_split(description_bullets, chr(10)), lambda x: '• ' || x), chr(10)) "
        "ELSE description END AS job_description, "
        "CASE WHEN skills <> '' THEN array_to_string(list_transform(string_split(skills, chr(10)), lambda x: '• ' || x), chr(10)) ELSE '• N/A' END AS key_skills, "
        f"location, experience, 'Naukri' AS source FROM ({NAUKRI_RUN})"
    ),
    "export_json_engine": (
        "SELECT id, file_name, company, title, location, url, descriptionSnippet, requiredSkills, fullDescription FROM ("
        "SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id DESC, pos DESC) AS rk FROM ("
        f"SELECT page_id, pos, 'scraped-' || {slug('company', 'naukri')} || '-' || {slug('job_role', 'job')} AS id, "
        f"{slug('company', 'naukri')} || '_' || {slug('job_role', 'job')} || '.json' AS file_name, company, job_role AS title, "
        f"CASE WHEN location = '' THEN {lit(K.JSON_LOCATION)} ELSE location END AS location, '#' AS url, {snippet('d')} AS descriptionSnippet, "
        "CASE WHEN skills <> '' THEN replace(skills, chr(10), '|') ELSE 'React|TypeScript|Python' END AS requiredSkills, d AS fullDescription FROM ("
        f"SELECT *, {export_desc('description', 'description_bullets', 'job_role', 'company')} AS d FROM ({NAUKRI_RUN})))) WHERE rk = 1"
    ),
}

EXTENSION_SQL["extension_page_types"] = (
    "SELECT CAST(s_suppkey * 2 AS BIGINT) AS page_id, 'listing-with-links' AS page_type, CAST(count(*) AS INTEGER) AS n_links, 0 AS n_data "
    f"FROM ({LISTING_JOBS}) GROUP BY s_suppkey UNION ALL "
    "SELECT CAST(job_id * 2 + 1 AS BIGINT), 'job', 0, 1 "
    f"FROM ({LISTING_JOBS})"
)


def _site_outcome(rows_sql: str, k: int, site: str, msg: str) -> str:
    kept = dedup_rc(rows_sql, "page_id, pos")
    return (
        f"SELECT CAST(f.page_id * 2 + {k} AS BIGINT) AS page_id, {lit(site)} AS source, coalesce(n, 0) > 0 AS success, "
        "CAST(f.total_found AS INTEGER) AS total_found, CAST(coalesce(n, 0) AS INTEGER) AS total_new, "
        f"CASE WHEN coalesce(n, 0) > 0 THEN '' ELSE {lit(msg)} END AS error_message FROM "
        f"(SELECT s_suppkey AS page_id, count(*) AS total_found FROM ({LISTING_JOBS}) GROUP BY s_suppkey) f "
        f"LEFT JOIN (SELECT page_id, count(*) AS n FROM ({kept}) GROUP BY page_id) k ON f.page_id = k.page_id"
    )


EXTRACT_SQL["site_outcomes"] = (
    _site_outcome(card_site_rows("Job posting for ", K.INDEED_CARD_COMPANY, "''"), 0, "Indeed", "No job cards extracted from Indeed page.")
    + " UNION ALL "
    + _site_outcome(card_site_rows("Job posting position for ", K.LINKEDIN_CARD_COMPANY, "''"), 1, "LinkedIn", "No job listings extracted from search page.")
)

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
REPORT_SQL["serial_lineitem"] = f"SELECT {_LINE}, row_number() OVER (ORDER BY {_LINE}) AS s_no FROM lineitem"
STREAM_SQL["stream_pages"] = PAGE_SQL["page_headings"]
STREAM_SQL["stream_status"] = f"SELECT {source_sql('url')} AS source, count(*) AS n FROM pages GROUP BY 1"
