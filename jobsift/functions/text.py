"""Scalar text functions (O-S1 … O-S22) as Spark Column expressions.

Every function takes and returns :class:`pyspark.sql.Column` values and is
built only from built-in expressions and higher-order functions, so it runs
inside the JVM (no Python per row).  Semantics follow the rules documented in
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

WS = K.PY_WS
JWS = K.JS_WS
DIGIT = "\\p{Nd}"  # Python ``\d`` on str patterns is Unicode Nd
PY_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
JS_WS_CHARS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _quick(ws: str) -> str:
    """The same class, with most characters that are no white space turned down by one range test."""
    return f"[\\x00-\\x20\\x7f-\\xa0\\u1680-\\uffff&&{ws}]"


def _runs(ws: str) -> str:
    """Runs of white space other than one blank (which a collapse leaves as it is)."""
    return f"{_quick('[' + ws + '&&[^ ]]')}{ws}*| {_quick(ws)}+"


WS_RUNS, JWS_RUNS = _runs(WS), _runs(JWS)
#: Characters that begin no bullet, line break or number: most of a text, turned down at once.
NO_SPLIT = "(?![:-~ -,./\\u00c0-\\u052f\\u4e00-\\u9fff])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Catalyst does not share repeated sub-expressions that sit inside
    higher-order-function lambdas; binding through a one-element
    ``transform`` keeps multi-step string rules linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


def nz(x) -> Column:
    """NULL → '' (the reference never has NULLs: absent is the empty string)."""
    return F.coalesce(_c(x), F.lit(""))


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.trim(_c(x), F.lit(PY_WS_CHARS))


_JS_ENDS = f"^{JWS}+|{JWS}+$"
NEL = "\x85"  # a line terminator to Java's ``$``, no white space to JavaScript


def js_trim(x) -> Column:
    """JavaScript ``String.prototype.trim`` (white space before a closing NEL goes too)."""
    return let(_c(x), lambda v: F.when(v.endswith(NEL), F.regexp_replace(v, _JS_ENDS, "")).otherwise(F.trim(v, F.lit(JS_WS_CHARS))))


def sql_re(pattern: str) -> str:
    """A Java regex as a Spark SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: str, var: str, body: str) -> str:
    """:func:`let` as SQL text."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {sql_re(WS_RUNS)}, ' '))"


def strip_sql(x: str) -> str:
    return f"btrim({x}, '{PY_WS_CHARS}')"


def js_trim_sql(x: str) -> str:
    return let_sql(x, "w0", f"CASE WHEN endswith(w0, '{NEL}') THEN regexp_replace(w0, {sql_re(_JS_ENDS)}, '') ELSE btrim(w0, '{JS_WS_CHARS}') END")


# --------------------------------------------------------------------------
# O-S1 clean text
# --------------------------------------------------------------------------
def clean_text(x) -> Column:
    """Collapse every whitespace run to one space and strip; NULL → ''."""
    return F.trim(F.regexp_replace(nz(x), WS_RUNS, " "))


def js_clean(x) -> Column:
    """``s.replace(/\\s+/g, ' ').trim()`` in JavaScript."""
    return F.trim(F.regexp_replace(nz(x), JWS_RUNS, " "))


# --------------------------------------------------------------------------
# O-S2 / O-S3 / O-S4 bullet splitting
# --------------------------------------------------------------------------
def _split_pattern(chars: str, chars_ws: bool, newline: str, digit: str) -> str:
    cls = "[" + chars + "]"
    head = f"{cls}{WS}*" if chars_ws else cls
    return f"{NO_SPLIT}(?:{head}|{newline}|(?:{digit}+[.)]){WS if digit == DIGIT else JWS}*)"


BASE_SPLIT = _split_pattern(K.BULLET_CHARS_BASE, True, "\\n+", DIGIT)
ENGINE_SPLIT = _split_pattern(K.BULLET_CHARS_ENGINE, True, "[\\n\\r]+", DIGIT)
EXT_SPLIT = _split_pattern(K.BULLET_CHARS_EXT, False, "\\n+", "[0-9]")
SENTENCE_SPLIT = f"(?<=[.!?]){WS}+"


def bullets_base(x) -> Column:
    """O-S2: split on bullet characters (and hyphen), newlines and ``1.``/``1)``.

    Pieces are cleaned and kept when longer than 10; when fewer than two
    survive, sentences longer than 15 are *appended*; at most 50 are kept.
    """
    t = nz(x)

    def pick(pieces):
        sentences = F.filter(F.transform(F.split(t, SENTENCE_SPLIT, -1), clean_text), lambda s: F.length(s) > 15)
        return F.slice(F.when(F.size(pieces) < 2, F.concat(pieces, sentences)).otherwise(pieces), 1, 50)

    pieces = F.filter(F.transform(F.split(t, BASE_SPLIT, -1), clean_text), lambda s: F.length(s) > 10)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(let(pieces, pick))


def bullets_engine(x) -> Column:
    """O-S4: listing-engine variant (no hyphen, len ≥ 15 input, > 10 pieces, 50 max)."""
    t = nz(x)
    pieces = F.filter(F.transform(F.split(t, ENGINE_SPLIT, -1), clean_text), lambda s: F.length(s) > 10)
    return F.when(F.length(t) < 15, F.array().cast("array<string>")).otherwise(F.slice(pieces, 1, 50))


def bullets_ext(x) -> Column:
    """O-S3: browser-extension variant (tags → newline, > 15, no lone stop-word, 100 max)."""
    t = nz(x)
    cleaned = F.regexp_replace(t, "<[^>]*>", "\n")
    stop = "(?i)^(" + "|".join(K.EXT_STOP_WORDS) + ")$"
    pieces = F.filter(
        F.transform(F.split(cleaned, EXT_SPLIT, -1), js_clean),
        lambda s: (F.length(s) > 15) & ~s.rlike(stop),
    )
    return F.when(F.length(t) < 20, F.array().cast("array<string>")).otherwise(F.slice(pieces, 1, 100))


# --------------------------------------------------------------------------
# O-S5 fingerprint
# --------------------------------------------------------------------------
def fingerprint(x) -> Column:
    """Lower-case, strip, collapse whitespace, first 100 characters."""
    return F.substring(F.regexp_replace(py_strip(F.lower(nz(x))), WS_RUNS, " "), 1, 100)


# --------------------------------------------------------------------------
# O-S6 experience, O-S7 location, O-S8 skills
# --------------------------------------------------------------------------
EXPERIENCE_RE = f"(?i)({DIGIT}+[-{WS[1:-1]}]to{WS}*{DIGIT}+|{DIGIT}+[-{WS[1:-1]}]*{DIGIT}+){WS}*Yrs?"


def experience(x) -> Column:
    """``"2 to 5 Yrs"`` → ``"2 to 5 Yrs"``; ``"3 Yrs"`` → ``""`` (two digit groups needed)."""
    return let(nz(x), lambda t: F.when(t.rlike(EXPERIENCE_RE), F.concat(py_strip(F.regexp_extract(t, EXPERIENCE_RE, 1)), F.lit(" Yrs"))).otherwise(F.lit("")))


def location_lookup(x) -> Column:
    """First place name (in list order) found case-insensitively in the text, else ''."""
    hits = let(F.lower(nz(x)), lambda low: F.filter(lit_array(K.PLACES), lambda p: F.instr(low, F.lower(p)) > 0))
    return F.coalesce(F.get(hits, 0), F.lit(""))


def skills_found(x) -> Column:
    """Reference skills whose lower-case form is a substring of the text, in list order."""
    return let(F.lower(nz(x)), lambda low: F.filter(lit_array(K.SKILLS_REF), lambda s: F.instr(low, F.lower(s)) > 0))


def skills_tag(x) -> Column:
    """O-S8 with the two default lists (empty text / nothing found)."""
    t = nz(x)
    return F.when(t == "", lit_array(K.SKILLS_DEFAULT_EMPTY_TEXT)).otherwise(
        let(skills_found(t), lambda found: F.when(F.size(found) == 0, lit_array(K.SKILLS_DEFAULT_NONE_FOUND)).otherwise(found))
    )


# --------------------------------------------------------------------------
# O-S9 company-name test
# --------------------------------------------------------------------------
def looks_like_company(x) -> Column:
    def body(v):
        t, low = v["t"], v["low"]
        first = F.substring(t, 1, 1)
        first_upper = (first == F.upper(first)) & (first != F.lower(first))
        has_suffix = F.exists(lit_array(K.COMPANY_SUFFIXES), lambda s: F.instr(low, s) > 0)

        def rest(caps):
            single_ok = (caps == 1) & F.length(t).between(4, 30) & ~F.array_contains(lit_array(K.NON_COMPANY_WORDS), low)
            return has_suffix | (caps >= 2) | single_ok

        return (F.length(t) >= 3) & first_upper & let(F.size(F.regexp_extract_all(t, F.lit("([A-Z][a-z]+)"), 1)), rest)

    return let(nz(x), lambda t: let(F.struct(t.alias("t"), py_strip(F.lower(t)).alias("low")), body))


# --------------------------------------------------------------------------
# O-S10 smart trim, O-S11 description choice, O-S12 labelled fields
# --------------------------------------------------------------------------
def substr_from(t: Column, start: Column) -> Column:
    """``t[start-1:]`` with a 1-based Column start."""
    return t.substr(start, F.lit(1 << 30))


def smart_trim(x) -> Column:
    """Cut from the earliest start marker (marker removed) to the earliest end marker.

    Texts shorter than 50 are returned unchanged; a result shorter than 30
    becomes ''.  Among start markers found at the same position the first in
    list order wins (so "Job Description" beats "Job Description:").
    """
    starts = lit_array(K.START_MARKERS)
    ends = lit_array(K.END_MARKERS)

    def from_start(t):
        return let(
            F.array_min(F.filter(F.transform(starts, lambda m: F.instr(t, m)), lambda i: i > 0)),
            lambda pos: F.when(pos.isNull(), t).otherwise(
                js_trim(substr_from(t, pos + F.length(F.get(F.filter(starts, lambda m: F.instr(t, m) == pos), 0))))
            ),
        )

    def to_end(a):
        e = F.array_min(F.filter(F.transform(ends, lambda m: F.instr(a, m)), lambda i: i > 0))
        return js_trim(a.substr(F.lit(1), F.coalesce(e, F.length(a) + 1) - 1))

    def body(t):
        return F.when(t.isNull() | (F.length(t) < 50), t).otherwise(
            let(let(from_start(t), to_end), lambda r: F.when(F.length(r) < 30, F.lit("")).otherwise(r))
        )

    return let(_c(x), body)


def choose_description(css: Column, fallback: Column) -> Column:
    """O-S11: CSS text vs page-text fallback (then smart-trimmed)."""
    def body(pair):
        c, fb = pair["c"], pair["f"]
        return (
            F.when((F.length(c) > 50) & (F.length(c) >= F.length(fb) * 0.8), c)
            .when(F.length(fb) >= 30, let(smart_trim(fb), lambda t: F.when(F.length(t) >= 30, t).otherwise(fb)))
            .otherwise(F.when(c != "", c).otherwise(fb))
        )

    return let(F.struct(nz(css).alias("c"), nz(fallback).alias("f")), body)


_TERM = "(?:\\n|•|·|\\||\\z)"
EMPLOYMENT_RE = f"(?i)(?:Employment|Job){JWS}*Type{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},/&-]+?){_TERM}"
DEPARTMENT_RE = f"(?i)Department{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},&/-]+?){_TERM}"
INDUSTRY_RE = f"(?i)Industry{JWS}*(?:Type)?{JWS}*:?{JWS}*([A-Za-z{JWS[1:-1]},&/-]+?){_TERM}"


def labelled_field(x, pattern: str) -> Column:
    """O-S12: first match of a labelled-field pattern in the first 20,000 chars, trimmed."""
    return let(F.substring(nz(x), 1, 20000), lambda head: F.when(head.rlike(pattern), js_trim(F.regexp_extract(head, pattern, 1))).otherwise(F.lit("")))


def employment_type(x) -> Column:
    return labelled_field(x, EMPLOYMENT_RE)


def department(x) -> Column:
    return labelled_field(x, DEPARTMENT_RE)


def industry(x) -> Column:
    return labelled_field(x, INDUSTRY_RE)


# --------------------------------------------------------------------------
# O-S13 … O-S22 presentation helpers
# --------------------------------------------------------------------------
def slug(x, default: str) -> Column:
    """Lower-case, non-alphanumeric runs → '_', strip '_'; empty → default."""
    s = F.regexp_replace(F.regexp_replace(F.lower(nz(x)), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return let(s, lambda v: F.when(v == "", F.lit(default)).otherwise(v))


def snippet(x, n: int = 220) -> Column:
    return let(nz(x), lambda t: F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, F.lit("...")).otherwise(F.lit(""))))


def split_skills(x) -> Column:
    """O-S15: comma string → trimmed non-empty items."""
    return F.filter(F.transform(F.split(nz(x), ",", -1), py_strip), lambda s: s != "")


def skills_list(x, text: bool) -> Column:
    """O-S15: a list as it is, one string split at commas; null is the empty list."""
    return split_skills(x) if text else F.coalesce(_c(x), F.array().cast("array<string>"))


def csv_escape(x) -> Column:
    """O-S19: quoted, with quotes doubled, if the value holds a comma, quote, CR or LF; NULL → ''."""
    return let(nz(x), lambda v: F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))


def bullet_lines(arr: Column) -> Column:
    """O-S16: ``• x`` per item joined by newline."""
    return F.array_join(F.transform(arr, lambda b: F.concat(F.lit("• "), b)), "\n")


def default_if_empty(x, default: str) -> Column:
    """O-S17: ``x or default``."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def bullets_or_description(bullets: Column, desc: Column) -> Column:
    """O-S18: ``(bullets or [desc]) if desc else []``."""
    def body(v):
        d, b = v["d"], v["b"]
        return F.when(d == "", F.array().cast("array<string>")).when(F.size(b) > 0, b).otherwise(F.array(d))

    return let(F.struct(nz(desc).alias("d"), bullets.alias("b")), body)


def export_description(desc: Column, bullets: Column, role: Column, company: Column) -> Column:
    """O-S22: description, else bullets joined by newline, else "{role} position at {company}."."""
    return (
        F.when(nz(desc) != "", desc)
        .when(F.size(bullets) > 0, F.array_join(bullets, "\n"))
        .otherwise(F.concat(nz(role), F.lit(" position at "), nz(company), F.lit(".")))
    )


def output_name(sources: Column, at: Column | None = None) -> Column:
    """O-S20: ``jobs_<sources>_<yyyyMMdd_HHmmss>`` with sources kept to alnum, space, '_' and '-'; ``at``: now by default."""
    clean = py_strip(F.regexp_replace(nz(sources), "[^\\p{L}\\p{N} _-]", ""))
    ts = F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")
    return let(clean, lambda c: F.when(c == "", F.concat(F.lit("jobs_scraped_"), ts)).otherwise(F.concat(F.lit("jobs_"), c, F.lit("_"), ts)))
