import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def base(text):
    return [f"{k}:{a}:{b}" for k, a, b, _ in pii.find(text) if k in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a1.@+ -()9é\n"), max_size=40))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "+49 (30) 123456-7", "x.y@z.co.uk", "@a.b@c.d", "300.1.1.1", "0007.1.1.1", " ", ".", "0", "-", "é"]), max_size=12))
def test_base_spans_match_the_patterns_on_pieces(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_added_kinds_need_checksum_or_context():
    assert [x[0] for x in pii.find("Konto DE89 3704 0044 0532 0130 00 bitte")] == ["iban"]
    assert pii.find("DE89 3704 0044 0532 0130 01") == []
    assert [x[0] for x in pii.find("her ssn 123-45-6789")] == ["ssn"]
    assert pii.find("part 123-45-6789") == []
    assert [x[0] for x in pii.find("call (499) 555-6503 now")] == ["local_phone"]
    assert pii.find("sum (499) 555-6503 now") == []
    assert [x[0] for x in pii.find("call +1 (499) 555-6503 now")] == ["phone"]
    near = {k: s for k, _, _, s in pii.find("visa card 4111 1111 1111 1111")}
    assert near["card"] == 1.0


def test_documents(spark, documents, odd, empty):
    for df, rows in ((frame(spark, documents), documents), (odd, odd_rows())):
        got = pii.scan(df).select("doc_id", *pii.digest()).collect()
        want = []
        for i, x, *_ in rows:
            b = brute(x)
            want.append((i, *[sum(s.startswith(k) for s in b) for k in RULES], hashlib.sha256(",".join(b).encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        for r in got:
            assert [s for s in r.spans.split(",") if s.split(":")[0] in RULES] == sorted(
                (s for s in r.spans.split(",") if s.split(":")[0] in RULES), key=lambda s: (int(s.split(":")[1]), list(RULES).index(s.split(":")[0])))
    assert pii.scan(empty).count() == pii.redact_table(empty).count() == 0


def test_redaction(spark, odd):
    df = frame(spark, [(1, "mail a@b.co or +49 30 1234567.", "en", "s"), (2, None, None, None)])
    rows = {r.doc_id: r for r in pii.redact_table(df).collect()}
    assert rows[1].text == "mail <EMAIL> or <PHONE>." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[2].n_chars is None
    assert pii.redact_table(odd).columns == odd.columns and pii.redact_table(odd).count() == odd.count()
