from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import chat, licenses


def brute_scan(rows, templates=licenses.TEMPLATES):
    """Containment in every window, without signatures."""
    import regex

    words = lambda x: regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())
    cut = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for t, (name, text) in enumerate(templates):
        s = cut(words(text))
        if not s:
            continue
        scale, want = 1, set(s)
        while scale < len(s):
            scale *= 2
        for i, x, *_ in rows:
            d = cut(words(x))
            for k in range(-(-len(d) // scale)):
                window = d[k * scale : (k + 2) * scale]
                both = want & set(window)
                if 10 * len(both) >= 8 * len(want):
                    at = k * scale + min(j for j, y in enumerate(window) if y in want)
                    share, first = out.get((i, t), (0, at))
                    out[i, t] = max(share, len(both) / len(want)), min(first, at)
    return sorted(((i, t, templates[t][0], *v) for (i, t), v in out.items()), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "template", "license", "contained", "first_word").collect()), key=str)


def planted():
    filler = " ".join(f"w{i}" for i in range(500))
    out = []
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        out.append((1000 + t, f"{filler} {text.upper()} {filler}", "en", "s"))
        out.append((1100 + t, f"{filler} {' '.join(words[: len(words) // 2])} {filler}", "en", "s"))
        if len(words) > 60:
            words[30] = "changed"
            out.append((1200 + t, " ".join(words), "en", "s"))
            out.append((1300 + t, text + "\n" + filler[:700] + "\n" + licenses.TEMPLATES[0][1], "en", "s"))
    return out


def test_licenses(spark, documents, odd, empty):
    rows = documents + planted()
    want = brute_scan(rows)
    assert {(1000 + t, t) for t in range(len(licenses.TEMPLATES))} <= {(r[0], r[1]) for r in want}
    assert found(licenses.scan(frame(spark, rows))) == want
    assert found(licenses.scan(odd)) == brute_scan(odd_rows())
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(frame(spark, rows), [("none", "too few words")]).count() == 0
    shared = [("one", "one two three four five six seven")]
    assert found(licenses.scan(odd, shared)) == brute_scan(odd_rows(), shared)


def test_versions_and_parts(spark):
    """Of two versions the one that is there is contained whole; a part is found in the whole, not the other way round."""
    at = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("GPL-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause")}
    rows = [(i, f"before it {text} and after", "en", "s") for i, text in enumerate(at.values())]
    got = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.contained
    assert got[0]["GPL-2.0"] == 1.0 > got[0]["GPL-3.0"] and got[1]["GPL-3.0"] == 1.0 > got[1]["GPL-2.0"]
    assert set(got[2]) == {"BSD-2-Clause"} and set(got[3]) == {"BSD-2-Clause", "BSD-3-Clause"}


def test_native(spark, documents):
    plan = licenses.scan(frame(spark, documents))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_pairs(rows):
    pairs = {}
    for p, chosen, turn, role, text in rows:
        if p is None:
            continue
        pairs.setdefault(p, ([], []))[0 if chosen else 1].append((turn, role, text))
    out = []
    none_first = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    for p, sides in pairs.items():
        c, r = (sorted(s, key=none_first) for s in sides)
        k = 0
        while k < min(len(c), len(r)) and c[k][1:] == r[k][1:]:
            k += 1
        show = lambda t: f"<|im_start|>{t[1] or ''}\n{t[2] or ''}<|im_end|>\n"
        masks = []
        for s in (c[k:], r[k:]):
            masks.append("".join(("0" * (13 + len(t[1] or "")) + ("1" if t[1] == "assistant" else "0") * (len(t[2] or "") + 11)) for t in s))
        out.append((p, k, len(c), len(r), *("".join(map(show, s)) for s in (c[:k], c[k:], r[k:])), *masks))
    return sorted(out, key=str)


def test_chat(spark):
    talk = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x"), ("assistant", "")]
    rows = []
    for p in range(1, 8):
        rows += [(p, True, i, *t) for i, t in enumerate(talk[: p % 7])]
        rows += [(p, False, i, t[0], t[1] if i < p - 3 else "other") for i, t in enumerate(talk[:4])]
    rows += [(20, True, 0, "user", "only")] + [(21, c, i, *t) for c in (True, False) for i, t in enumerate(talk)]
    rows += [(22, True, 1, "user", "b"), (22, True, 1, "user", "a"), (22, True, 1, "user", "a"), (22, False, None, None, None), (None, True, 0, "user", "q")]
    df = spark.createDataFrame(rows, "pair_id BIGINT, chosen BOOLEAN, turn BIGINT, role STRING, text STRING").selectExpr("*", "1 AS c", "2 AS r", "3 AS k", "4 AS prompt")
    got = chat.format_pairs(df)
    masks = lambda runs: "".join(("1" if r.trained else "0") * r.length for r in runs)
    have = [(*tuple(r)[:7], masks(r.chosen_mask), masks(r.rejected_mask)) for r in got.collect()]
    assert sorted(have, key=str) == brute_pairs(rows)
    for r in have:
        assert len(r[5]) == len(r[7]) and len(r[6]) == len(r[8])
    assert chat.format_pairs(df.where("false")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pairs_from_conversations(spark):
    """Own reply against the neighbour's, behind the same prompt."""
    talks = {
        0: [("user", "q0"), ("assistant", "a0"), ("user", "more"), ("assistant", "b0"), ("user", "bye")],
        1: [("user", "q1"), ("assistant", "a1")],
        2: [("user", "nobody answers")],
        3: [("assistant", "a3")],
        5: [("user", "q5"), ("assistant", None)],
        6: [("user", "same"), ("assistant", "same")],
        7: [("user", "other"), ("assistant", "same")],
    }
    rows = [(i, n, *t) for i, talk in talks.items() for n, t in enumerate(talk)] + [(None, 0, "user", "lost"), (None, 1, "assistant", "lost")] * 50
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").selectExpr("*", "1 AS k", "2 AS t0", "3 AS l1")
    got = {r.pair_id: r for r in chat.format_sides(chat.swapped_replies(df)).collect()}
    show = lambda *turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    assert set(got) == {0, 1, 3, 5, 6, 7}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == (show(*talks[0][:3]), show(("assistant", "b0")), show(("assistant", "a1")))
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (show(("user", "q1")), show(("assistant", "a1")), show(("assistant", "b0")))
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected) == (0, show(("assistant", "a3")), "")
    assert (got[5].chosen, got[5].rejected) == (show(("assistant", "")), "")
    assert (got[6].prompt, got[6].chosen, got[6].rejected) == (show(*talks[6]), "", "")  # equal replies are all prompt
    assert [r.trained for r in got[0].chosen_mask] == [False, True]
    assert chat.swapped_replies(df.where("false")).count() == 0
