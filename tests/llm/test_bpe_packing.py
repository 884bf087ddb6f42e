import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from jobsift.llm import bpe, packing
from jobsift.llm.wordcode import WordEncoder, read_json

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODE = WordEncoder(read_json(PATH))
LIBRARY.no_truncation()

texts = st.one_of(
    st.text(max_size=80),
    st.text(st.sampled_from("aAbéÉ .,'s1\t\n\x0b\x0c\r\x1c\x85\xa0İΣς́‑日😀<|endoftext|>"), max_size=80),
    st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "The", "the,", "it's", "...", "x1.", " ", "\n", "é", "́"]), max_size=20).map("".join),
)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(texts)
def test_encoding_by_words_and_decoding(text):
    got = CODE.encode(text.encode("utf-8", "replace"))
    assert np.frombuffer(got, "<u4").tolist() == ids(text.encode("utf-8", "replace").decode())
    assert CODE.decode(got) == LIBRARY.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(st.integers(0, 200), max_size=8), st.randoms())
def test_chunks_cut_anywhere_are_repaired(text, places, rng):
    raw = text.encode("utf-8", "replace")
    if any(s in raw for s in CODE.special):
        return
    ends = sorted({bpe._border(raw, min(p, len(raw))) for p in places if raw} - {0} | ({len(raw)} if raw else set()))
    coded = [bpe.encode_chunk(CODE, raw[a:b]) if rng.random() < 0.7 else None for a, b in zip([0, *ends], ends)]
    assert np.frombuffer(bpe.assemble(CODE, raw, ends, coded), "<u4").tolist() == ids(raw.decode())


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a = bpe.chunks(b"first " * 50 + passage)
    b = bpe.chunks(b"another beginning " * 77 + passage)
    assert len(set(a) & set(b)) >= len(a) - 6
    assert b"".join(a) == b"first " * 50 + passage
    for raw in ("日本語" * 5000).encode(), b"", b"x" * 100_000, ("é " * 9999).encode():
        ends = bpe.cuts(raw)
        assert b"".join(bpe.chunks(raw)) == raw and (not raw or ends[-1] == len(raw))
        for e in ends:
            raw[:e].decode()


def digest(x):
    i = np.array(ids(x), "<u4").tobytes()
    return len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(LIBRARY.decode(ids(x), skip_special_tokens=False).encode()).hexdigest()


def test_bpe_documents(spark, documents, odd, empty):
    passage = " ".join(f"word{i} that, repeats" for i in range(900))
    copies = [(1000 + i, f"Opening{i} {passage} closing{i} <|endoftext|>"[: -13 * (i % 2) or None], "en", "s") for i in range(8)]
    for df, rows in ((frame(spark, documents + copies), documents + copies), (odd, odd_rows())):
        coded = bpe.encode(df, PATH).withColumn("d", bpe.decode_column("ids", PATH)).collect()
        got = sorted(((r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.d.encode()).hexdigest()) for r in coded), key=str)
        assert got == sorted(((i, *digest(x)) for i, x, *_ in rows), key=str)
    assert bpe.encode(empty, PATH).count() == 0


@pytest.mark.parametrize("window", [2048, 16])
def test_packing(spark, documents, odd, window):
    for df, rows in ((frame(spark, documents).repartition(5), documents), (odd, odd_rows())):
        pieces = packing.pack(df, PATH, window=window)
        got = pieces.collect()
        by_doc = {}
        for p in got:
            assert 0 < p.length <= window and p.length * 4 == len(p.ids)
            by_doc.setdefault(p.doc_id, []).append(p)
        want = {}
        for i, x, *_ in rows:
            want.setdefault(i, []).append(np.array([*ids(x), 1], "<u4").tobytes())
        assert {i: sum(map(len, v)) for i, v in want.items()} == {i: sum(len(p.ids) for p in v) for i, v in by_doc.items()}
        for i, v in by_doc.items():
            if len(want[i]) == 1:
                assert b"".join(p.ids for p in sorted(v, key=lambda p: p.start)) == want[i][0]
                assert [p.start for p in sorted(v, key=lambda p: p.start)][0] == 0 and {p.doc_tokens for p in v} == {len(want[i][0]) // 4}
        stream = sorted(got, key=lambda p: (p.sequence_id, p.offset))
        at = 0
        for p in stream:  # gapless, and every sequence full but the last
            assert p.sequence_id * window + p.offset == at
            at += p.length
        crc = {(r.doc_id, r.start, r.crc) for r in pieces.selectExpr("doc_id", "start", "crc32(ids) AS crc").collect()}
        assert crc == {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in got}
        whole = packing.sequences(pieces, window, pad_id=7).collect()
        assert {r.sequence_id for r in whole} == set(range(-(-at // window)))
        last = at % window or window
        for r in whole:
            full = r.sequence_id < at // window
            assert len(r.ids) == 4 * (window if full or last & (last - 1) else last)


def test_packing_empty(empty):
    assert packing.pack(empty, PATH).count() == 0
