"""CSS-style selection over shredded pages (O-H2 … O-H9, O-H12).

Selectors compile, on the driver, into Spark higher-order-function Columns
over the ``nodes`` array of one page, so selection is page-local: no join
and no shuffle.  Supported subset (everything the extractors use):

* type ``div``, universal ``*``, class ``.a``, id ``#a``
* attributes ``[a]`` ``[a=v]`` ``[a*=v]`` ``[a^=v]`` ``[a$=v]`` ``[a~=v]``
* ``:nth-child(k)``
* combinators: descendant (space) and child ``>``; groups with ``,``

A group keeps document order without duplicates (it is one ``filter`` over
the node array).  ``scope`` limits matches to the descendants of one node,
which is how selection inside a card works.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shred import BLOCK_SEP, TEXT_SEP


@dataclass
class Compound:
    tag: str | None = None
    classes: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    nth: int | None = None


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<comb>[>,])
    | (?P<tag>\*|[a-zA-Z][a-zA-Z0-9-]*)
    | \.(?P<cls>[-\w]+)
    | \#(?P<id>[-\w]+)
    | \[\s*(?P<an>[-\w:]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[-\w]+))\s*)?\]
    | :nth-child\(\s*(?P<nth>\d+)\s*\)
    )""",
    re.X,
)


@lru_cache(maxsize=None)
def parse(css: str):
    """CSS text → list of alternatives; each is a list of (combinator, Compound)."""
    groups, chain, cur, comb = [], [], None, None
    pos = 0
    s = css.strip()
    while pos < len(s):
        m = _TOKEN.match(s, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector syntax at {s[pos:]!r} in {css!r}")
        gap = m.group(0)[: len(m.group(0)) - len(m.group(0).lstrip())]
        pos = m.end()
        if m.group("comb"):
            if m.group("comb") == ",":
                chain.append((comb, cur))
                groups.append(chain)
                chain, cur, comb = [], None, None
            else:
                chain.append((comb, cur))
                cur, comb = None, ">"
            continue
        if cur is not None and gap:
            chain.append((comb, cur))
            cur, comb = None, " "
        if cur is None:
            cur = Compound()
        if m.group("tag"):
            cur.tag = None if m.group("tag") == "*" else m.group("tag").lower()
        elif m.group("cls"):
            cur.classes.append(m.group("cls"))
        elif m.group("id"):
            cur.ids.append(m.group("id"))
        elif m.group("an"):
            val = m.group("dq") if m.group("dq") is not None else m.group("sq") if m.group("sq") is not None else m.group("bare")
            cur.attrs.append((m.group("an").lower(), m.group("op"), val))
        elif m.group("nth"):
            cur.nth = int(m.group("nth"))
    chain.append((comb, cur))
    groups.append(chain)
    return groups


def attr(n: Column, name: str) -> Column:
    """Attribute value or NULL."""
    if name == "class":
        return F.when(F.map_contains_key(n["attrs"], "class"), n["cls"])
    return F.try_element_at(n["attrs"], F.lit(name))


def _compound_pred(c: Compound, n: Column) -> Column:
    preds = []
    if c.tag:
        preds.append(n["tag"] == c.tag)
    for k in c.classes:
        preds.append(F.instr(F.concat(F.lit(" "), n["cls"], F.lit(" ")), f" {k} ") > 0)
    for i in c.ids:
        preds.append(attr(n, "id") == i)
    for name, op, val in c.attrs:
        v = attr(n, name)
        if op is None:
            preds.append(F.map_contains_key(n["attrs"], name))
        elif op == "=":
            preds.append(v == val)
        elif val == "":
            preds.append(F.lit(False))
        elif op == "*=":
            preds.append(F.instr(v, val) > 0)
        elif op == "^=":
            preds.append(v.startswith(val))
        elif op == "$=":
            preds.append(v.endswith(val))
        elif op == "~=":
            preds.append(F.array_contains(F.split(F.trim(v), " +"), val))
        elif op == "|=":
            preds.append((v == val) | v.startswith(val + "-"))
    if c.nth is not None:
        preds.append(n["sib"] == c.nth)
    out = F.lit(True)
    for p in preds:
        out = p if out is None else (out & p)
    return F.coalesce(out, F.lit(False))


def _chain_pred(chain, n: Column, nodes: Column) -> Column:
    comb, last = chain[-1]
    pred = _compound_pred(last, n)
    if len(chain) == 1:
        return pred
    rest = chain[:-1]
    if comb == ">":
        parent = F.get(nodes, n["parent"])
        return pred & F.coalesce(_chain_pred(rest, parent, nodes), F.lit(False))
    return pred & F.exists(nodes, lambda a: (a["pre"] < n["pre"]) & (n["pre"] <= a["last"]) & _chain_pred(rest, a, nodes))


def matches(css: str, n: Column, nodes: Column) -> Column:
    out = None
    for chain in parse(css):
        p = _chain_pred(chain, n, nodes)
        out = p if out is None else (out | p)
    return out


def inside(n: Column, scope: Column) -> Column:
    """``n`` is a proper descendant of ``scope``."""
    return (n["pre"] > scope["pre"]) & (n["pre"] <= scope["last"])


def subtree(nodes: Column, scope: Column) -> Column:
    """The descendants of ``scope``: a contiguous slice in pre-order (empty for NULL scope)."""
    empty = F.array().cast(nodes_type_hint(nodes))
    return let(scope, lambda sc: F.coalesce(F.slice(nodes, sc["pre"] + 2, sc["last"] - sc["pre"]), empty))


def nodes_type_hint(nodes: Column) -> str:
    from ..sources.shred import NODE_DDL

    return f"array<struct<{NODE_DDL}>>"


# ---------------------------------------------------------------------------
# SQL-text fast path for page-level selection over the top-level ``nodes``
# column: one ``expr`` call instead of dozens of Column round trips.
# ---------------------------------------------------------------------------
def sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_top(nodes: Column) -> bool:
    return str(nodes) == "Column<'nodes'>"


def _attr_sql(v: str, name: str) -> str:
    if name == "class":
        return f"CASE WHEN map_contains_key({v}.attrs, 'class') THEN {v}.cls END"
    return f"try_element_at({v}.attrs, {sql_str(name)})"


def _compound_sql(c: Compound, v: str) -> str:
    preds = []
    if c.tag:
        preds.append(f"{v}.tag = {sql_str(c.tag)}")
    for k in c.classes:
        preds.append(f"instr(concat(' ', {v}.cls, ' '), {sql_str(' ' + k + ' ')}) > 0")
    for i in c.ids:
        preds.append(f"{_attr_sql(v, 'id')} = {sql_str(i)}")
    for name, op, val in c.attrs:
        a = _attr_sql(v, name)
        if op is None:
            preds.append(f"map_contains_key({v}.attrs, {sql_str(name)})")
        elif op == "=":
            preds.append(f"{a} = {sql_str(val)}")
        elif val == "":
            preds.append("false")
        elif op == "*=":
            preds.append(f"instr({a}, {sql_str(val)}) > 0")
        elif op == "^=":
            preds.append(f"startswith({a}, {sql_str(val)})")
        elif op == "$=":
            preds.append(f"endswith({a}, {sql_str(val)})")
        elif op == "~=":
            preds.append(f"array_contains(split(trim({a}), ' +'), {sql_str(val)})")
        elif op == "|=":
            preds.append(f"({a} = {sql_str(val)} OR startswith({a}, {sql_str(val + '-')}))")
    if c.nth is not None:
        preds.append(f"{v}.sib = {c.nth}")
    return "coalesce(" + (" AND ".join(f"({p})" for p in preds) if preds else "true") + ", false)"


def _chain_sql(chain, v: str, depth: int = 0) -> str:
    comb, last = chain[-1]
    pred = _compound_sql(last, v)
    if len(chain) == 1:
        return pred
    rest = chain[:-1]
    if comb == ">":
        return f"({pred} AND coalesce({_chain_sql(rest, f'get(nodes, {v}.parent)', depth + 1)}, false))"
    a = f"a{depth}"
    return f"({pred} AND exists(nodes, {a} -> {a}.pre < {v}.pre AND {v}.pre <= {a}.last AND {_chain_sql(rest, a, depth + 1)}))"


def matches_sql(css: str, v: str) -> str:
    return "(" + " OR ".join(_chain_sql(ch, v) for ch in parse(css)) + ")"


def _find_sql(v: str, tags=None, cls_re=None, attrs=None, ignore_case=False) -> str:
    flag = "(?i)" if ignore_case else ""
    p = ["true"]
    if tags:
        tags = [tags] if isinstance(tags, str) else list(tags)
        p.append(f"{v}.tag IN ({', '.join(sql_str(t) for t in tags)})")
    if cls_re is not None:
        p.append(f"map_contains_key({v}.attrs, 'class') AND {v}.cls RLIKE {sql_str(flag + cls_re)}")
    for k, val in (attrs or {}).items():
        if val is True:
            p.append(f"map_contains_key({v}.attrs, {sql_str(k)})")
        else:
            p.append(f"coalesce({_attr_sql(v, k)} RLIKE {sql_str(flag + val)}, false)")
    return " AND ".join(f"({x})" for x in p)


def node_sql(css: str) -> str:
    """SQL: first page-level match of ``css`` (NULL if none)."""
    return f"get(filter(nodes, n0 -> {matches_sql(css, 'n0')}), 0)"


def raw_text_sql(node: str) -> str:
    """SQL: the node's slice of ``buf`` (node bound once through a one-element transform)."""
    return f"get(transform(array({node}), m -> CASE WHEN m IS NULL THEN NULL ELSE substring(buf, m.t0 + 1, greatest(m.t1 - m.t0, 0)) END), 0)"


def text_sql(node: str, mode: str = "text", sep: str = "") -> str:
    """SQL: ``textContent`` (``text``), ``get_text(sep)`` (``sep``) or ``innerText`` (``inner``)."""
    raw = raw_text_sql(node)
    if mode == "text":
        return f"translate({raw}, concat(chr(0), chr(1)), '')"
    if mode == "sep":
        return f"regexp_replace({raw}, '[\\\\x00\\\\x01]', {sql_str(sep)})"
    if mode == "inner":
        return f"translate({raw}, concat(chr(1), chr(0)), chr(10))"
    raise ValueError(mode)


def is_top_pair(buf: Column, nodes: Column) -> bool:
    return _is_top(nodes) and str(buf) == "Column<'buf'>"


def _simple_descendant(chain) -> bool:
    return len(chain) == 2 and chain[1][0] == " "


def select_all(nodes: Column, css: str, scope: Column | None = None) -> Column:
    """Matches of ``css`` in document order.

    For ``A B`` alternatives the candidate ancestors ``A`` are filtered once
    per page (bound with ``let``), so the containment test is
    O(|B| × |A|) instead of O(|B| × nodes).
    """
    if scope is None and _is_top(nodes):
        return F.expr(f"filter(nodes, n0 -> {matches_sql(css, 'n0')})")
    src = nodes if scope is None else subtree(nodes, scope)
    groups = parse(css)
    if not any(_simple_descendant(ch) for ch in groups):
        return F.filter(src, lambda n: matches(css, n, nodes))
    anc_preds = [(_compound_pred_fn(ch[0][1]) if _simple_descendant(ch) else None) for ch in groups]
    cand = F.struct(*[
        (F.filter(nodes, p) if p is not None else F.array().cast(nodes_type_hint(nodes))).alias(f"a{i}")
        for i, p in enumerate(anc_preds)
    ])

    def pick(c):
        def pred(n):
            out = None
            for i, ch in enumerate(groups):
                if _simple_descendant(ch):
                    p = _compound_pred(ch[1][1], n) & F.exists(c[f"a{i}"], lambda a: (a["pre"] < n["pre"]) & (n["pre"] <= a["last"]))
                else:
                    p = _chain_pred(ch, n, nodes)
                out = p if out is None else (out | p)
            return out

        return F.filter(src, pred)

    return let(cand, pick)


def _compound_pred_fn(c: Compound):
    return lambda a: _compound_pred(c, a)


def select_one(nodes: Column, css: str, scope: Column | None = None) -> Column:
    return F.get(select_all(nodes, css, scope), 0)


def count(nodes: Column, css: str) -> Column:
    """O-A4: number of elements matching a selector."""
    return F.size(select_all(nodes, css))


# ---------------------------------------------------------------------------
# bs4-style searches (tag list + attribute regex)
# ---------------------------------------------------------------------------
def find_pred(n: Column, tags=None, cls_re: str | None = None, attrs: dict | None = None, ignore_case: bool = False) -> Column:
    """``find_all(tags, class_=re.compile(cls_re), attrs={...})`` predicate.

    Attribute values in ``attrs`` are regexes (searched) or ``True`` (present).
    """
    flag = "(?i)" if ignore_case else ""
    p = F.lit(True)
    if tags:
        tags = [tags] if isinstance(tags, str) else list(tags)
        p = p & n["tag"].isin(tags)
    if cls_re is not None:
        p = p & F.map_contains_key(n["attrs"], "class") & n["cls"].rlike(flag + cls_re)
    for k, v in (attrs or {}).items():
        if v is True:
            p = p & F.map_contains_key(n["attrs"], k)
        else:
            p = p & F.coalesce(attr(n, k).rlike(flag + v), F.lit(False))
    return p


def find_all(nodes: Column, tags=None, cls_re=None, attrs=None, ignore_case=False, scope: Column | None = None) -> Column:
    if scope is None and _is_top(nodes):
        return F.expr(f"filter(nodes, n0 -> {_find_sql('n0', tags, cls_re, attrs, ignore_case)})")
    src = nodes if scope is None else subtree(nodes, scope)
    return F.filter(src, lambda n: find_pred(n, tags, cls_re, attrs, ignore_case))


def find(nodes: Column, tags=None, cls_re=None, attrs=None, ignore_case=False, scope: Column | None = None) -> Column:
    return F.get(find_all(nodes, tags, cls_re, attrs, ignore_case, scope), 0)


# ---------------------------------------------------------------------------
# O-H9 element text
# ---------------------------------------------------------------------------
def raw_text(buf: Column, n: Column) -> Column:
    """The node's slice of ``buf`` with markers (NULL without a node); ``n`` is bound once."""
    return let(n, lambda m: F.when(m.isNotNull(), buf.substr(m["t0"] + 1, F.greatest(m["t1"] - m["t0"], F.lit(0)))))


def text(buf: Column, n: Column) -> Column:
    """``get_text()`` / ``textContent``: the text nodes concatenated (NULL if no node)."""
    return F.translate(raw_text(buf, n), TEXT_SEP + BLOCK_SEP, "")


def text_sep(buf: Column, n: Column, sep: str) -> Column:
    """``get_text(separator=sep)``."""
    return F.regexp_replace(raw_text(buf, n), "[\\x00\\x01]", sep)


def inner_text(buf: Column, n: Column) -> Column:
    """``innerText``: block boundaries become newlines."""
    return F.translate(raw_text(buf, n), BLOCK_SEP + TEXT_SEP, "\n")


def page_text(buf: Column) -> Column:
    return F.translate(buf, TEXT_SEP + BLOCK_SEP, "")


def page_inner_text(buf: Column) -> Column:
    return F.translate(buf, BLOCK_SEP + TEXT_SEP, "\n")
