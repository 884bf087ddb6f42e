"""Generic extractors (O-X1 … O-X6, O-H12).

Four strategies over one shredded page, each an ``ARRAY<STRUCT<company,
role, description>>`` Column in document order:

* JSON-LD scripts (parsed with ``try_parse_json`` into VARIANT),
* HTML tables (header words pick the columns),
* card-like elements (16 selectors, class fallback, custom selectors),
* text patterns over the page text (``regexp_extract_all``).

:func:`heuristic_items` takes the first non-empty strategy (O-X5) and
:func:`generic_jobs` applies the generic post-processing (O-X6) except the
run-wide dedup, which is a window over all pages (see ``plans``).
"""

from __future__ import annotations

from .memo import cached_column

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.text import let
from . import select as S
from .jobs import first_nonempty, job

WS = T.WS


def item(company, role, desc) -> Column:
    return F.struct(T.nz(company).alias("company"), T.nz(role).alias("role"), T.nz(desc).alias("description"))


def _no_items() -> Column:
    return F.filter(F.array(item(F.lit(""), F.lit(""), F.lit(""))), lambda x: F.lit(False))


# ---------------------------------------------------------------------------
# O-X1 JSON-LD
# ---------------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _vtext(v: Column, path: str) -> Column:
    """The string at ``path``; '' if it is missing or an empty value; NULL for any other value, which is no text."""
    kind, text = _kind(F.try_variant_get(v, path, "variant")), F.try_variant_get(v, path, "string")
    blank = kind.isNull() | (kind == "VOID") | text.isin("0", "0.0", "false", "[]", "{}")
    return F.when(kind == "STRING", text).when(F.coalesce(blank, F.lit(False)), F.lit("")).otherwise(F.lit(None).cast("string"))


def _found(company, role, desc) -> Column:
    """An item whose values may be no text: it counts as found and gives no job."""
    return F.struct(company.alias("company"), role.alias("role"), desc.alias("description"))


def _given(x: Column) -> Column:
    return x.isNull() | (x != "")


def _type_has(v: Column, word: str, exact_names=()) -> Column:
    """``word in item.get('@type', '')`` (substring for a string, membership for a list)."""
    t = F.try_variant_get(v, "$['@type']", "variant")
    k = _kind(t)
    s = F.try_variant_get(v, "$['@type']", "string")
    lst = F.try_variant_get(v, "$['@type']", "array<string>")
    as_str = F.instr(s, word) > 0
    for name in exact_names:
        as_str = as_str | (s == name)
    return F.coalesce(F.when(k == "STRING", as_str).when(k.startswith("ARRAY"), F.array_contains(lst, word)), F.lit(False))


def _jsonld_item(v: Column) -> Column:
    """Items of one JSON-LD object (several for an ItemList)."""
    ho = F.try_variant_get(v, "$.hiringOrganization", "variant")
    company_jp = F.when(_kind(ho).startswith("OBJECT"), _vtext(ho, "$.name")).when(_kind(ho) == "STRING", F.try_variant_get(ho, "$", "string")).otherwise(F.lit(""))
    desc_jp = let(_vtext(v, "$.description"), lambda d: F.when(d == "", _vtext(v, "$.responsibilities")).otherwise(d))
    is_job = _type_has(v, "JobPosting")
    is_org = _type_has(v, "Organization", exact_names=("Corporation", "Company", "LocalBusiness"))
    is_list = _type_has(v, "ListItem") | _type_has(v, "ItemList")
    elements = F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.filter(
        F.transform(
            F.filter(elements, lambda e: _kind(e).startswith("OBJECT")),
            lambda e: let(F.coalesce(F.try_variant_get(e, "$.item", "variant"), e), lambda d: _found(_vtext(d, "$.name"), F.lit(K.JSONLD_LIST_ROLE), F.lit(""))),
        ),
        lambda x: _given(x["company"]),
    )
    single = (
        F.when(is_job, F.array(_found(company_jp, _vtext(v, "$.title"), desc_jp)))
        .when(is_org, F.array(_found(_vtext(v, "$.name"), F.lit(K.JSONLD_ORG_ROLE), F.lit(""))))
        .otherwise(_no_items())
    )
    kept = F.filter(single, lambda x: _given(x["company"]) & _given(x["role"]))
    return F.when(~is_job & ~is_org & is_list, listed).otherwise(kept)


def jsonld_items(nodes: Column) -> Column:
    """Every ``script[type=application/ld+json]``; bad JSON or an empty script gives no rows,
    a non-object array element is skipped on its own."""
    scripts = F.filter(nodes, lambda n: (n["tag"] == "script") & (F.coalesce(S.attr(n, "type"), F.lit("")) == "application/ld+json"))

    def per_script(s):
        v = F.try_parse_json(F.try_element_at(s["attrs"], F.lit("#text")))
        objs = F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda o: F.coalesce(_kind(o).startswith("OBJECT"), F.lit(False)))
        return F.flatten(F.transform(objs, _jsonld_item))

    return F.flatten(F.transform(scripts, per_script))


# ---------------------------------------------------------------------------
# O-X2 tables
# ---------------------------------------------------------------------------
def _any_word(h: Column, words) -> Column:
    return F.exists(T.lit_array(words), lambda w: F.instr(h, w) > 0)


def _strip_text(buf: Column, n: Column) -> Column:
    """``get_text(strip=True)``."""
    parts = F.split(S.raw_text(buf, n), "[\\x00\\x01]", -1)
    return F.array_join(F.filter(F.transform(parts, T.py_strip), lambda s: s != ""), "")


def table_items(buf: Column, nodes: Column) -> Column:
    def per_table(t):
        return let(S.find_all(nodes, "tr", scope=t), lambda rows: table_body(t, rows))

    def table_body(t, rows):
        thead = S.find(nodes, "thead", scope=t)
        head_cells = F.when(thead.isNotNull(), S.find_all(nodes, "th", scope=thead)).otherwise(S.find_all(nodes, "th", scope=F.get(rows, 0)))
        headers = F.transform(head_cells, lambda th: F.lower(_strip_text(buf, th)))

        def with_headers(h):
            idx = F.sequence(F.lit(0), F.size(h) - 1)
            idx = F.when(F.size(h) > 0, idx).otherwise(F.array().cast("array<int>"))
            is_c = lambda i: _any_word(F.get(h, i), K.TABLE_HEADER_COMPANY)
            is_r = lambda i: _any_word(F.get(h, i), K.TABLE_HEADER_ROLE)
            is_d = lambda i: _any_word(F.get(h, i), K.TABLE_HEADER_DESC)
            ccol = F.coalesce(F.array_max(F.filter(idx, is_c)), F.lit(-1))
            rcol = F.coalesce(F.array_max(F.filter(idx, lambda i: ~is_c(i) & is_r(i))), F.lit(-1))
            dcol = F.coalesce(F.array_max(F.filter(idx, lambda i: ~is_c(i) & ~is_r(i) & is_d(i))), F.lit(-1))
            start = F.when(F.size(h) > 0, F.lit(1)).otherwise(F.lit(0))
            sample = F.get(rows, start)
            sample_cells = S.find_all(nodes, ["td", "th"], scope=sample)
            hint = F.array_position(
                F.transform(sample_cells, lambda c: F.exists(T.lit_array(K.TABLE_COMPANY_CELL_HINTS), lambda s: F.instr(F.lower(_strip_text(buf, c)), s) > 0)),
                True,
            ).cast("int") - 1
            cols = F.struct(F.when(ccol >= 0, ccol).otherwise(hint).alias("c"), rcol.alias("r"), dcol.alias("d"))

            def rows_with(cc):
                ccol_, rcol_, dcol_ = cc["c"], cc["r"], cc["d"]

                def per_row(r):
                    def with_cells(cells):
                        cell_text = lambda i: T.clean_text(S.text(buf, F.get(cells, i)))
                        first = cell_text(F.lit(0))
                        company = F.when((ccol_ >= 0) & (ccol_ < F.size(cells)), cell_text(ccol_)).otherwise(
                            let(first, lambda f: F.when(T.looks_like_company(f), f).otherwise(F.lit("")))
                        )
                        role = F.when((rcol_ >= 0) & (rcol_ < F.size(cells)), cell_text(rcol_)).otherwise(F.lit(""))
                        desc = F.when((dcol_ >= 0) & (dcol_ < F.size(cells)), cell_text(dcol_)).otherwise(F.lit(""))
                        return F.when(F.size(cells) > 0, item(company, T.default_if_empty(role, K.GENERIC_DEFAULT_ROLE), desc))

                    return let(S.find_all(nodes, ["td", "th"], scope=r), with_cells)

                data_rows = F.slice(rows, start + 1, F.greatest(F.size(rows) - start, F.lit(0)))
                out = F.transform(data_rows, per_row)
                return F.filter(out, lambda x: x.isNotNull() & (x["company"] != ""))

            return let(cols, rows_with)

        return F.when(F.size(rows) < 2, _no_items()).otherwise(let(headers, with_headers))

    return F.flatten(F.transform(S.find_all(nodes, "table"), per_table))


# ---------------------------------------------------------------------------
# O-X3 cards
# ---------------------------------------------------------------------------
GENERIC_CARD_SELECTORS = [
    "div[class*='card']", "div[class*='item']", "div[class*='list-item']",
    "div[class*='result']", "div[class*='entry']", "li[class*='list']",
    "article", "div[class*='company']", "div[class*='job']",
    "div[class*='tuple']", "div[class*='row']", "li[class*='item']",
    "div[class*='listing']", "section[class*='card']",
    "div[data-company]", "div[data-job]",
]
CLASS_FALLBACK = ["company", "employer", "job-card", "listing"]


def generic_cards(nodes: Column) -> Column:
    first = first_nonempty(*[S.select_all(nodes, s) for s in GENERIC_CARD_SELECTORS])

    def fallback():
        opts = [S.find_all(nodes, None, cls_re=c, ignore_case=True) for c in CLASS_FALLBACK]
        def pick(nxt):
            return lambda a: F.when(F.size(a) > 1, a).otherwise(nxt)

        out = F.array().cast(S.nodes_type_hint(nodes))
        for o in reversed(opts):
            out = let(o, pick(out))
        return out

    return let(first, lambda a: F.when(F.size(a) > 0, a).otherwise(fallback()))


def card_items(buf: Column, nodes: Column, custom: dict | None = None) -> Column:
    custom = {k: v for k, v in (custom or {}).items() if v}

    def per_card(c):
        els1 = S.find_all(nodes, ["a", "span", "div", "h3", "h4", "h2", "strong"], cls_re="company|org|employer|name|title|heading", ignore_case=True, scope=c)
        els2 = S.find_all(nodes, ["a", "strong", "h3", "h4", "h2"], scope=c)

        def auto(els):
            texts = F.filter(F.transform(els, lambda e: T.clean_text(S.text(buf, e))), lambda t: F.length(t) > 1)
            return let(F.transform(texts, lambda t: F.struct(t.alias("t"), T.looks_like_company(t).alias("c"))), lambda tc: F.struct(
                F.coalesce(F.get(F.filter(tc, lambda x: x["c"]), 0)["t"], F.lit("")).alias("company"),
                F.coalesce(F.get(F.filter(tc, lambda x: ~x["c"]), 0)["t"], F.lit("")).alias("role"),
            ))

        desc_el = S.find(nodes, ["p", "div", "span"], cls_re="description|desc|summary|details|info|about", ignore_case=True, scope=c)
        desc = F.coalesce(F.when(desc_el.isNotNull(), T.clean_text(S.text(buf, desc_el))), F.lit(""))
        found = let(F.when(F.size(els1) > 0, els1).otherwise(els2), auto)

        def cust(key):
            if key not in custom:
                return F.lit("")
            el = S.select_one(nodes, custom[key], scope=c)
            return F.coalesce(F.when(el.isNotNull(), T.clean_text(S.text(buf, el))), F.lit(""))

        def filled(v):
            """Custom values stand; what they leave open is detected.  A detected description replaces a custom one,
            unless custom company and role make the item by themselves."""
            company = F.when(v["c"] != "", v["c"]).otherwise(found["company"])
            role = F.when(v["r"] != "", v["r"]).otherwise(found["role"])
            detected = F.when(company != "", item(company, T.default_if_empty(role, K.GENERIC_DEFAULT_ROLE), F.when(desc_el.isNotNull(), desc).otherwise(v["d"])))
            return F.when((v["c"] != "") & (v["r"] != ""), item(v["c"], v["r"], v["d"])).otherwise(detected)

        if custom:
            return let(F.struct(cust("company").alias("c"), cust("role").alias("r"), cust("description").alias("d")), filled)
        return F.when(found["company"] != "", item(found["company"], T.default_if_empty(found["role"], K.GENERIC_DEFAULT_ROLE), desc))

    return F.filter(F.transform(generic_cards(nodes), per_card), lambda x: x.isNotNull())


# ---------------------------------------------------------------------------
# O-X4 text patterns
# ---------------------------------------------------------------------------
_WSI = WS[1:-1]
HIRING_RE = "(?im)((?:" + "|".join(K.COMPANY_SUFFIXES) + f"){WS}+(?:is|are|has){WS}+hiring)"
JOIN_RE = f"(?im)Join{WS}+([A-Z][A-Za-z0-9{_WSI}&.]+?){WS}+(?:as{WS}+(?:a|an){WS}+)?([A-Z][A-Za-z{_WSI}/]+)"
LEGAL_RE = f"(?im)([A-Z][A-Za-z0-9{_WSI}&.-]+?){WS}+(?:" + K.TEXT_PATTERN_LEGAL_FORMS.replace("\\s", WS) + f"){WS}"


def text_pattern_items(buf: Column) -> Column:
    text = S.page_text(buf)
    one = lambda pat: F.transform(F.regexp_extract_all(text, F.lit(pat), 1), lambda m: item(T.clean_text(m), F.lit(""), F.lit("")))
    pairs = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(JOIN_RE), 1).alias("a"), F.regexp_extract_all(text, F.lit(JOIN_RE), 2).alias("b")),
        lambda z: item(T.clean_text(z["a"]), T.clean_text(z["b"]), F.lit("")),
    )
    allm = F.concat(one(HIRING_RE), pairs, one(LEGAL_RE))
    kept = F.filter(allm, lambda x: F.length(x["company"]) > 2)
    return F.transform(kept, lambda x: item(x["company"], T.default_if_empty(x["role"], K.GENERIC_DEFAULT_ROLE), F.lit("")))


# ---------------------------------------------------------------------------
# O-X5 cascade, O-X6 post-processing
# ---------------------------------------------------------------------------
STRATEGIES = ("jsonld", "tables", "cards", "text")


def strategy_items(buf: Column, nodes: Column, name: str, custom: dict | None = None) -> Column:
    if name == "jsonld":
        return jsonld_items(nodes)
    if name == "tables":
        return table_items(buf, nodes)
    if name == "cards":
        return card_items(buf, nodes, custom)
    if name == "text":
        return text_pattern_items(buf)
    raise ValueError(name)


@cached_column
def heuristic_items(buf: Column, nodes: Column, custom: dict | None = None, strategies=STRATEGIES) -> Column:
    """O-X5: the first strategy that yields any item supplies all of them."""
    return first_nonempty(*[strategy_items(buf, nodes, s, custom) for s in strategies])


@cached_column
def generic_jobs(items: Column) -> Column:
    """O-X6 per item: strip, drop short / navigation companies and items with a value that is no text, defaults and bullets.

    Each job carries ``dedup_key`` (description[:100] or company) for the
    run-wide O-D2 dedup.
    """
    def one(x):
        company, role, desc = T.py_strip(x["company"]), T.py_strip(x["role"]), T.py_strip(x["description"])
        keep = (F.length(company) >= 2) & role.isNotNull() & desc.isNotNull() & ~F.array_contains(T.lit_array(K.GENERIC_REJECTED_COMPANIES), F.lower(company))
        bullets = F.when(desc != "", T.bullets_base(desc)).otherwise(F.array().cast("array<string>"))
        return F.when(keep, job(
            company=company, job_role=T.default_if_empty(role, K.GENERIC_DEFAULT_ROLE), description=desc,
            description_bullets=T.bullets_or_description(bullets, desc), source=F.lit("Generic"),
        ))

    return F.filter(F.transform(items, one), lambda j: j.isNotNull())
