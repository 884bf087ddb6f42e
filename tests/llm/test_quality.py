import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import quality as q


def brute_counts(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    win = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
    punctuation = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - set("#*$%&|<>")
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), sum(y in lines[:i] for i, y in enumerate(lines)), len(covered),
        len(lines), sum(c.isascii() and c.isalpha() for c in x), sum(c.isascii() and c.isupper() for c in x), sum(c in punctuation for c in x),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab A#.\n\té"), max_size=60))
def test_counts(text):
    assert q.counts(text) == brute_counts(text)


def bucket(v):
    s = max(v.bit_length() - 6, 0)
    return v >> s << s


def brute(rows, reach, prior):
    n = {i: dict(zip(q.COUNTS, brute_counts(r[1]))) for i, r in enumerate(rows)}
    ratio = lambda c, k, off=0: max(c[q.RATIOS[k][0]] - off, 0) * q.RATIOS[k][1] // c[q.RATIOS[k][2]] if c[q.RATIOS[k][2]] else 0
    failed = {i: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for i, c in n.items()}
    groups = defaultdict(list)
    for i, (_, _, lang, source) in enumerate(rows):
        if not failed[i]:
            for at in ((2, lang, source), (1, lang, None), (0, None, None)):
                groups[at].append(i)

    def limits(at, k):
        v = sorted(bucket(ratio(n[j], k)) for j in groups[at])
        cut = lambda p: v[-(-len(v) * p // 100) - 1]
        up, least = cut(q.UPPER), max(cut(q.UPPER) // 32, 1)
        own = up + reach * max(up - cut(50), least), max(cut(100 - q.UPPER) - reach * max(cut(50) - cut(100 - q.UPPER), least), 0)
        if at[0] == 0:
            return own
        above = limits((1, at[1], None) if at[0] == 2 else (0, None, None), k)
        return tuple((len(v) ** 2 * x + prior**2 * y) // (len(v) ** 2 + prior**2) for x, y in zip(own, above))

    out = []
    for i, (doc, _, lang, source) in enumerate(rows):
        fine = not failed[i]
        for k in q.RATIOS if fine else ():
            high, low = limits((2, lang, source), k)
            fine &= ratio(n[i], k, q.TOLERANCE.get(k, 0)) <= high
            fine &= k != "word_length" or ratio(n[i], k) >= low
        out.append((doc, *n[i].values(), failed[i], fine))
    return sorted(out, key=str)


def test_documents(spark, documents):
    got = q.quality(frame(spark, documents), reach=3, prior=20).select("doc_id", *q.COUNTS, "base_failed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(documents, 3, 20)


def test_odd_table(odd):
    got = q.quality(odd, prior=2).select("doc_id", *q.COUNTS, "base_failed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(odd_rows(), q.REACH, 2)


def test_filter_keeps_columns_and_what_passes(spark, documents, odd, empty):
    df = frame(spark, documents)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and q.keep_good(odd).columns == odd.columns
    want = sorted(r.doc_id for r in q.quality(df).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert q.keep_good(empty).count() == q.quality(empty).count() == 0


def table(n, text, lang="en", source="a", first=0):
    return [(first + i, text(i), lang, source) for i in range(n)]


def words(i, n=60):
    return " ".join(f"w{(i * 7 + j * j) % 997}x{j}" for j in range(n))


def test_thresholds_follow_the_group(spark):
    """What is rare in one source and usual in another is rejected in the first only; clean rows stay."""
    plain = table(600, words)
    code = table(300, lambda i: words(i) + " #" * 40, source="code", first=1000)
    junk = [(5000, words(1) + " #" * 40, "en", "a"), (5001, words(2) + " #" * 2, "en", "a")]
    kept = {r.doc_id for r in q.quality(frame(spark, plain + code + junk)).where("kept").collect()}
    assert kept == {r[0] for r in plain + code} | {5001}


def test_repeated_lines_are_rejected_in_long_texts(spark):
    lines = lambda i, n: "\n".join(f"{words(i * 50 + j, 12)}." for j in range(n))
    clean = table(300, lambda i: lines(i, 30))
    one = [(900, lines(901, 30) + "\n" + lines(901, 1), "en", "a")]
    many = [(901, "\n".join(lines(902, 20).split("\n") + lines(902, 8).split("\n")), "en", "a")]
    kept = {r.doc_id for r in q.quality(frame(spark, clean + one + many)).where("kept").collect()}
    assert kept == {r[0] for r in clean} | {900}


def test_small_groups_lean_on_their_parents(spark):
    """A source of three documents, two of them junk, is judged by its language."""
    rows = table(300, words) + [(700 + i, words(i) + (" #" * 30 if i else ""), "en", "tiny") for i in range(3)]
    kept = {r.doc_id for r in q.quality(frame(spark, rows)).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {701, 702}
