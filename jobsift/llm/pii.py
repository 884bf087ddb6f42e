"""Operator 1 — personal data: patterns propose, checksums confirm, context scores.

Patterns propose spans per kind; validators (octet range, Luhn, mod-97, digit
counts, area rules) confirm them; words near a span raise or lower its score.
Kinds whose pattern and checksum are strong are reported at any score; the
weak kinds (a telephone number without country code, a national insurance or
social security number) only where nearby words lift the score to
``MIN_SCORE``.

Every pattern is read in one forward pass whose cost is linear in the text,
also on hostile input (long digit runs, ``a@a@a@…``): no start is tried twice.
The operator is a column function over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty

#: Kinds of the contract, then the ones this operator adds, in the order of ties.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
RANK = {k: i for i, k in enumerate(KINDS)}

# FIXED VALUES: the contract's patterns.  Look-behinds and possessive runs leave
# the matches as they are and spare the starts that can't match.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: IBAN lengths by country (ISO 13616 registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

#: Score of a confirmed span without context, and the words that move it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
RAISE = {
    "email": {"email", "mail", "contact", "e-mail"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"},
    "iban": {"iban", "account", "bank", "konto", "transfer"},
    "ssn": {"ssn", "social", "security", "tax", "taxpayer"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"},
}
LOWER = {
    "ip": {"version", "release", "section"},
    "card": {"isbn", "order", "serial", "tracking"},
    "ssn": {"part", "model", "serial", "order"},
    "local_phone": {"part", "model", "serial", "order", "isbn"},
}
#: Characters on either side in which context words count, what a word moves, and the least score of a weak kind.
NEAR, STEP, MIN_SCORE = 40, 0.25, 0.5
_WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces, and its country's length."""
    return IBAN_LENGTH.get(iban[:2]) == len(iban) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed (start, end, kind), before context."""
    if "@" in text:
        for a, b in _emails(text):
            yield a, b, "email"
    for m in IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            yield *m.span(), "ip"
    for m in CARD.finditer(text):
        # a run with 11 or fewer characters can't hold 12 digits
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield *m.span(), "card"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield *m.span(), "phone"
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield *m.span(), "iban"
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), "ssn"
    for m in LOCAL_PHONE.finditer(text):
        yield *m.span(), "local_phone"


def score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's own score, moved by the distinct words around the span."""
    around = set(_WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(_WORD.findall(text[end : end + NEAR].lower()))
    moved = SCORE[kind] + STEP * len(around & RAISE[kind]) - STEP * len(around & LOWER.get(kind, set()))
    return round(min(1.0, max(0.0, moved)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive.

    Base kinds stay at any score.  A kind that this operator adds is left out
    where it lies inside a base span, or below ``MIN_SCORE``.
    """
    found = sorted((a, RANK[k], b) for a, b, k in proposals(text))
    out, reach = [], 0
    for a, rank, b in found:
        kind = KINDS[rank]
        s = score(text, a, b, kind)
        if kind in BASE:
            out.append((kind, a, b, s))
            reach = max(reach, b)
        elif s >= MIN_SCORE and a >= reach:
            out.append((kind, a, b, s))
    covered = [(a, b) for k, a, b, _ in out if k in BASE]
    return [x for x in out if x[0] in BASE or not any(a < x[2] and x[1] < b for a, b in covered)] if len(covered) < len(out) else out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_column(text: str = "text") -> Column:
    """All spans of a whole text; null counts as empty."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for t in texts.to_pylist()], kind)

    return run(text_or_empty(text))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``.

    Null and empty texts have no spans; repeated rows are scanned one by one;
    an empty table gives an empty table.  Further columns are not read.
    """
    return docs.select("doc_id", spans_column().alias("spans"))


def redacted_column(text: str = "text") -> Column:
    """The text with each span as ``<KIND>``; overlapping spans merge under the first one's kind."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t) for t in texts.to_pylist()], pa.string())

    return run(F.col(text))


def redact(text: str | None) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for kind, a, b, _ in find(text):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def digest(spans: str = "spans") -> list[Column]:
    """The contract's columns from an array of spans."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return [*[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]


def base_digest(text: str) -> str:
    """For tests: the digest of the base spans of one text."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in find(text) if k in BASE).encode()).hexdigest()


def redact_table(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<KIND>``; ``n_chars`` follows where there is one.

    Null texts stay null; every row and column stays.
    """
    new = free_name(docs, "_text")
    marked = docs.withColumn(new, redacted_column())
    size = F.when(F.col(new) == docs["text"], docs["n_chars"]).otherwise(F.coalesce(F.length(new), docs["n_chars"])).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return marked.select(*[F.col(new).alias(c) if c == "text" else size.alias(c) if c == "n_chars" else docs[c] for c in docs.columns])
