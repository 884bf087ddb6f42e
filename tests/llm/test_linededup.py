import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import linededup as ld
from jobsift.llm.common import Staged


def brute(rows):
    """{(doc_id, line number): stays} by comparing all lines with all."""
    where = {}
    for i, x, *_ in rows:
        for number, line in ld.lines(x or ""):
            where.setdefault(line, []).append((i, number))
    found = list(where)
    cut = lambda x, k: {x[i : i + k] for i in range(max(1, len(x) - k + 1))}
    views = [[cut(x, 5) if len(x) < 150 else None for x in found], [cut(x, 9) if len(x) >= 120 else None for x in found]]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if any(v[i] and v[j] and 5 * len(v[i] & v[j]) >= 4 * len(v[i] | v[j]) for v in views):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])  # noqa: E731  nulls first, as Spark sorts
    for i, line in enumerate(found):
        for p in where[line]:
            first[find(i)] = min(first.get(find(i), p), p, key=order)
    return {p: first[find(i)] == p for i, line in enumerate(found) for p in where[line]}


def rebuilt(rows):
    stays = brute(rows)
    out = []
    for i, x, *_ in rows:
        t = None if x is None else "\n".join(y for n, y in enumerate(x.split("\n")) if stays.get((i, n), True))
        out.append((i, t))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def variants(seed=3):
    """Copies with one word changed, a chain of ever more changes, and lines that share half of their text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        line = list(base)
        line[rng.randrange(60)] = word()
        rows.append((1100 + i, "\n".join([" ".join(line), word(), ""]), "en", "s"))
    chain = list(base[::-1])
    for i in range(12):
        chain[5 * i % 60] = word()
        rows.append((1200 + i, " ".join(chain).upper(), "en", "s"))
    half = " ".join(base[:30])
    rows += [(1300 + i, half + " " + " ".join(word() for _ in range(40)), "en", "s") for i in range(40)]
    return rows


def test_documents_and_variants(spark, documents):
    rows = documents[:120] + variants()
    assert found(ld.dedup_lines(frame(spark, rows))) == rebuilt(rows)


@pytest.mark.parametrize(("block", "listed"), [(300, 0), (1 << 20, 0), (2000, 1 << 20)])
def test_heavy_buckets_go_through_lists_and_blocks(spark, documents, monkeypatch, block, listed):
    rows = documents[:40] + variants() + short_variants()
    expected, blocks = rebuilt(rows), []
    monkeypatch.setattr(ld, "DIRECT", 0)  # a single pair between parts makes a bucket heavy
    monkeypatch.setattr(ld, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ld, "LISTED", listed)
    dealt = ld._block_links
    monkeypatch.setattr(ld, "_block_links", lambda heavy, text: blocks.append(heavy.count()) or dealt(heavy, text))
    assert found(ld.dedup_lines(frame(spark, rows))) == expected
    assert blocks


def test_similar_lines_share_a_prefix_list():
    some = [ld.norm(x.split("\n")[0]) for _, x, *_ in variants(4) + short_variants(4)]
    some = [x for x in dict.fromkeys(some) if x]
    counts = pa.Table.from_batches(list(ld._shingle_counts([pa.record_batch([pa.array(some)], names=["t"])]))).to_pydict()
    rarity = np.zeros(ld.SLOTS, np.int16)
    rarity[counts["slot"]] = (8 * np.log2(counts["n"])).astype(np.int16)
    sizes = [[len(ld.shingles(x, k)) if ld.in_view(len(x), v) else None for x in some] for v, (k, *_) in enumerate(ld.VIEWS)]
    keys = [i.to_bytes(4) for i in range(len(some))]
    buckets = [[b for v in range(2) if sizes[v][i] is not None for b in (v - 8, 16 + v)] for i in range(len(some))]
    batch = pa.record_batch([pa.array(keys), pa.array(keys), pa.array(some), *[pa.array(s, pa.int32()) for s in sizes], pa.array(buckets)], names=["key", "part", "t", "size0", "size1", "buckets"])
    (out,) = ld._prefix_lists(SimpleNamespace(value=rarity))([batch])
    lists, met, similar = {}, set(), 0
    for b, k in zip(out["bucket"].to_pylist(), out["key"].to_pylist(), strict=True):
        lists.setdefault(b, []).append(int.from_bytes(k))
    for b, of in lists.items():
        met.update((i, j, b & 1) for i in of for j in of)
    for v, (k, *_) in enumerate(ld.VIEWS):
        for i, x in enumerate(some):
            for j in range(i):
                if sizes[v][i] and sizes[v][j] and ld.similar(ld.shingles(x, k), ld.shingles(some[j], k)):
                    similar += 1
                    assert (i, j, v) in met
    assert similar > 100
    assert len(lists) % 2 == 0 and len(met) < len(some) ** 2


def test_odd_table(odd):
    got = ld.dedup_lines(odd)
    assert got.columns == odd.columns
    assert found(got) == rebuilt(odd_rows())
    for r in got.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_rows_without_id_or_with_the_same_are_documents_of_their_own(spark):
    line = lambda name: f"only {name} has a line of these words about {name * 5}"
    copied = "a line that several rows repeat word by word, with no change at all"
    rows = [(None, f"{copied}\n{line('ann')}", "en", "s"), (None, f"{line('bob')}\n{copied}", "en", "s"), (None, f"{copied}\n{line('cid')}", "en", "s")]
    rows += [(7, f"{copied}\n{line('dan')}", "en", "s"), (7, f"{line('eve')}\n{copied}", "en", "s"), (7, line("eve"), "en", "s")]
    texts = [t for _, t in found(ld.dedup_lines(frame(spark, rows).coalesce(1)))]
    assert sorted(texts) == sorted([rows[0][1], line("bob"), line("cid"), line("dan"), line("eve"), ""])


def test_empty(empty):
    assert ld.dedup_lines(empty).count() == 0


def test_pairs_at_the_threshold_share_a_band():
    rng, met, n = random.Random(7), 0, 400
    for _ in range(n):
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
        other = list(line)
        while ld.alike("".join(line), "".join(other)):
            last, other = other, list(other)
            other[rng.randrange(400)] = "#"
        a, b = ld.bands(["".join(line), "".join(last)], 1)
        met += bool((a == b).any())
    assert met >= 0.98 * n


def test_few_pairs_at_the_threshold_miss_every_band():
    assert (1 - ld.SIMILARITY**ld.ROWS) ** ld.BANDS < 0.002
    rng, n, texts = random.Random(8), 4000, []
    for _ in range(n):  # 200 shingles of 250 are shared
        core = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(208))
        texts += [core + "".join(rng.choice("ABCDEFGHIJ") for _ in range(25)), core + "".join(rng.choice("KLMNOPQRST") for _ in range(25))]
    assert all(ld.alike(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True))
    b = ld.bands(texts, 1)
    missed = int((~(b[::2] == b[1::2]).any(axis=1)).sum())
    assert missed < 0.004 * n


def test_prefix_filter_links_what_all_pairs_would():
    rng = random.Random(11)
    lines = [x for _, x, *_ in variants(9)]
    lines = [ld.norm(x.split("\n")[0]) for x in lines]
    rng.shuffle(lines)
    rows = [(bytes([i]), i, x) for i, x in enumerate(lines)]
    check_links(lines, rows, list(ld.part_links(rows, 9, 0)))
    check_links(lines, rows, list(ld.part_links(rows, 9, 10**9)))


def test_links_of_parts_join_what_a_pair_joins(monkeypatch):
    """Lines of some common texts with few to many changes, in parts of their own or of several lines."""
    for seed in range(40):
        rng = random.Random(seed)
        k, n = rng.choice([5, 9]), rng.randint(1, 90)
        base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 6))]
        rows = []
        for i in range(n):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                line[rng.randrange(len(line))] = rng.choice("xyzuvw")
            rows.append((bytes([i]), rng.randint(0, n if seed % 2 else 5), "".join(line)))
        sets = [ld.shingles(x, k) for *_, x in rows]
        alike = [(i, j) for i in range(n) for j in range(i) if rows[i][1] != rows[j][1] and ld.similar(sets[i], sets[j])]
        want = joined_parts(rows, alike)
        for counted in (0, 3, 10**9):
            monkeypatch.setattr(ld, "COUNTED", counted)
            for direct in (0, 10**9):
                got = [(a[0], b[0]) for a, b in ld.part_links(rows, k, direct)]
                assert {(max(x), min(x)) for x in got} <= set(alike)
                assert joined_parts(rows, got) == want
    assert list(ld.part_links([], 5, 0)) == []


def joined_parts(rows, pairs):
    """The parts of (key, part, line) after the pairs, by row number, have joined theirs."""
    groups = {p: {p} for _, p, _ in rows}
    for i, j in pairs:
        one = groups[rows[i][1]] | groups[rows[j][1]]
        groups.update(dict.fromkeys(one, one))
    return {frozenset(x) for x in groups.values()}


def check_links(lines, rows, links):
    assert len(links) < len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    for i, x in enumerate(lines):
        for j, y in enumerate(lines):
            if ld.similar(ld.shingles(x, 9), ld.shingles(y, 9)):
                assert find(i) == find(j)


def short_variants(seed=5):
    """Lines of 40 to 200 characters, each with a copy in which one number or word is another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6)))
    rows = []
    for i in range(60):
        size = 40 + 160 * i // 60
        line = []
        while len(" ".join(line)) < size - 8:
            line.append(word())
        at = rng.randrange(1, len(line))
        line[at] = str(2000 + i)
        rows += [(3000 + 2 * i, " ".join(line), "en", "s"), (3001 + 2 * i, " ".join([*line[:at], str(3000 + i) if i % 2 else word()[:4], *line[at + 1 :]]), "en", "s")]
    return rows


def test_short_lines_with_one_word_or_number_changed(spark):
    rows = short_variants()
    got = found(ld.dedup_lines(frame(spark, rows)))
    assert got == rebuilt(rows)
    gone = {i for i, t in got if t == ""}
    assert all(i in gone for i, t, *_ in rows if i % 2 and 80 <= len(t) < 120)  # four changed characters spoil eight shingles of five
    assert sum(i in gone for i, t, *_ in rows if len(t) < 80) >= 5


def test_band_lists_by_length():
    some = ["ab", "x" * 119 + "y", "z" * 149 + "w", "q" * 151, "abcde" * 20]
    each = ld._band_lists(some).to_pylist()
    assert [len(x) for x in each] == [12, 24, 12 if len(some[2]) >= 150 else 24, 12, 12]
    assert [sorted({b & 1 for b in x}) for x in each] == [[0], [0, 1], [1], [1], [0]]
    assert ld._band_lists([]).to_pylist() == []


def edited_pairs(n=1500, seed=11):
    rng, pairs = random.Random(seed), []
    letters = ["ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyzäöüß0123456789 ,.", "".join(map(chr, range(0x4E00, 0x5200))), "a\0"]
    for _ in range(n):
        some = rng.choice(letters)
        a = [rng.choice(some) for _ in range(rng.choice([1, 3, 4, 5, 8, 9, 50, 119, 120, 149, 150, 400]))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 2, 3, 8])):
            b[rng.randrange(len(b))] = rng.choice(some)
        pairs.append(("".join(a), "".join(b) + "".join(rng.choice(some) for _ in range(rng.choice([0, 0, 1, 5])))))
    return pairs


def test_pairs_in_batches_are_judged_as_one_by_one():
    pairs = edited_pairs()
    want = [ld.alike(a, b) for a, b in pairs]
    got, may = [], []
    for i in range(0, len(pairs), 100):
        ta, tb = map(list, zip(*pairs[i : i + 100], strict=True))
        got += ld.alike_pairs(ta, tb)
        may += ld.may_be_similar(ta, tb).tolist()
    assert got == want
    assert 100 < sum(want) < len(want) - 100
    assert not any(w and not m for w, m in zip(want, may, strict=True))
    assert sum(may) < 1.2 * sum(want)


def test_no_shingle_sets_for_pairs_that_are_far_apart(monkeypatch):
    rng, made = random.Random(12), []
    ta, tb = ([" ".join(f"{rng.randrange(10**6):x}" for _ in range(60)) for _ in range(50)] for _ in "ab")
    plain = ld.shingles
    monkeypatch.setattr(ld, "shingles", lambda line, k: made.append(line) or plain(line, k))
    keys = pa.array([i.to_bytes(16) for i in range(50)], pa.binary())
    (out,) = ld._verified([pa.record_batch([keys, keys, pa.array(ta), pa.array(tb)], names=["a", "b", "ta", "tb"])])
    assert out.num_rows == 0 and not made


def test_shared_values_by_slots(monkeypatch):
    rng, slots = random.Random(13), 7
    monkeypatch.setattr(ld, "SENT", 50)  # several rows of a slot from one scan
    lines = [(ld.key(str(i)), [rng.randrange(-40, 40) for _ in range(3)]) for i in range(40)]
    rows = [(k, v) for k, v in lines for _ in range(rng.choice([1, 1, 2]))] + [(lines[0][0], None)] * 3
    rng.shuffle(rows)
    packed = [None if v is None else np.array(v, np.int64).tobytes() for _, v in rows]
    batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + 10]], pa.binary()), pa.array(packed[i : i + 10], pa.binary())], names=["key", "bands"]) for i in range(0, len(rows), 10)]
    sent = pa.Table.from_batches(list(ld._sent(slots)(batches))).to_pylist()
    assert len(sent) > slots
    got = []
    for slot in range(slots):
        if own := [x for x in sent if x["slot"] == slot]:
            got += ld._shared_values(pa.Table.from_pylist(own)).to_pylist()
    head = lambda k: int.from_bytes(k[:8], "little", signed=True)
    holders = {}
    for k, v in rows:
        for x in v or ():
            holders.setdefault(x, set()).add(head(k))
    want = [(x, min(of)) for x, of in holders.items() if len(of) > 1]
    want += [(head(k), None) for k in {k for k, _ in rows} if sum(k == other for other, _ in rows) > 1]
    key = lambda x: (x[1] is None, x[0])
    assert sorted(((x["value"], x["least"]) for x in got), key=key) == sorted(want, key=key)
