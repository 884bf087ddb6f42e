"""Operator 13 — token counts of every prefix by dynamic programming.

For a byte-level BPE the tokens of a piece's prefix are those of a shorter
prefix and one more token: the token ``t`` that ends at ``i`` and stays next to
the last token of the prefix of ``i - len(t)`` when the two are encoded
together.  One pass over the ends ``i`` gives the exact count of every prefix,
each from a shorter one.  A text is cut into units by the tokenizer's own
pattern (white space and what follows it); the counts of a text's prefixes are
those of its units one after another.

Stored is, per code point, by how much the count changes (16 bits each, in
blocks with the count before them and the smallest one inside).  "How many
tokens has this prefix" and "what is the longest prefix within this budget" are
then answered from one block, without encoding anything.

Workers remember the steps of units they have met, in a memo of fixed size that
is emptied when full.  A text's memory is a few times its length.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .wordcode import byte_letters, read_json

#: Code points of a block; entries of a worker's largest memo (about 200 bytes each); characters that are cut up at once.
BLOCK, MEMO, SEGMENT = 65_536, 600_000, 1 << 20
#: The limit of the registered query.
LIMIT = 512

_CORE = r"(?:(?<! )'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d+|(?:[^\w\s]|_)+)"
_UNIT, _UNIT_ASCII = re.compile(rf"\s*{_CORE}"), re.compile(rf"\s*{_CORE}", re.ASCII)
_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:]) (?=[A-Za-z0-9])")
_EDGE = re.compile(r"\s | \s")
_WORD_SIGNS = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)")
_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
#: A character of each class, for characters that Python and the tokenizer put in different ones.
_STAND_IN = {"letter": "a", "number": "1", "space": "\t", "other": "!"}


def _changes(counts: list[int]) -> bytes:
    """The differences between neighbouring counts, the first against 0, as little-endian 16-bit integers."""
    return struct.pack(f"<{len(counts)}h", *map(sub, counts, [0, *counts]))


class _Steps(dict):
    """Steps by text; made by ``make`` when first asked for, forgotten when there are too many."""

    def __init__(self, make, size=MEMO // 4):
        self.make, self.size = make, size

    def __missing__(self, text):
        if len(self) >= self.size:
            self.clear()
        out = self[text] = self.make(text)
        return out


class PrefixCounter:
    """Token counts of all prefixes of a text, for a ``tokenizers`` JSON text with byte-level BPE."""

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tok = tokenizers.Tokenizer.from_str(json_text)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        sample = "I'll see 12 of  them\n\nall's\tw'ell _ok_ ... 3rd 's ''s\r\n x"
        self.model, self.letters = self.tok.model, byte_letters()
        pieces = [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(sample)]
        if self.tok.normalizer or pieces != ["I", "'ll", "Ġsee", "Ġ12", "Ġof", "Ġ", "Ġthem", "Ċ", "Ċ", "all", "'s", "ĉ", "w", "'", "ell", "Ġ_", "ok", "_", "Ġ...", "Ġ3", "rd", "Ġ'", "s", "Ġ''", "s", "čĊ", "Ġx"]:
            raise ValueError("not a byte-level BPE with the usual pattern")
        special = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.names = {i: t for t, i in vocab.items()} | {-1: ""}
        self.tokens = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.tokens.add_word(t, (len(t), i))
        self.tokens.make_automaton()
        self.pairs = _Steps(self._stay_apart, MEMO // 2)
        self.pieces = _Steps(self._piece)
        self.units = _Steps(self._unit)
        self.chunks = _Steps(self._chunk, MEMO)
        self.classes = _Steps(self._stand_in)

    # --- the dynamic programme

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens (-1: none) are what their letters encode to."""
        before, t = pair
        found = [x.id for x in self.model.tokenize(self.names[before] + self.names[t])]
        return found == ([before, t] if before >= 0 else [t])

    def _counts(self, letters: str) -> list[int]:
        """The counts of the prefixes of 0, 1, … letters of a piece."""
        last, count, done, pairs = [-1], [0], 0, self.pairs
        for end, (n, t) in self.tokens.iter(letters):  # per end, the tokens that end there, longest first
            if end == done and pairs[last[end + 1 - n], t]:  # exactly one fits
                last.append(t)
                count.append(count[end + 1 - n] + 1)
                done += 1
        return count

    def _piece(self, piece: str) -> list[int]:
        """The counts of all prefixes (in characters, from 1) of one piece of the tokenizer's pattern."""
        raw = piece.encode()
        count = self._counts(raw.decode("latin-1").translate(self.letters))
        if len(raw) == len(piece):
            return count[1:]
        ends = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80] + [len(raw)]
        return [count[i] for i in ends]

    def _unit(self, key: tuple[str, str]) -> bytes:
        """The steps of white space and the word, number, signs or contraction behind it; key: the unit, its classes."""
        unit, shape = key
        n = len(shape) - len(shape.lstrip())
        counts = list(self.pieces[unit[:n]]) if n else []  # white space at a prefix's end is one piece
        core, before = unit[n:], 0
        if n and unit[n - 1] == " ":
            before, core = self.pieces[unit[: n - 1]][-1] if n > 1 else 0, unit[n - 1 :]
        elif n:
            before = (self.pieces[unit[: n - 1]][-1] if n > 1 else 0) + self.pieces[unit[n - 1]][-1]
        if _CONTRACTION.fullmatch(core):  # until it is whole, a sign and letters
            inner = [self.pieces["'"][-1], *(self.pieces["'"][-1] + x for x in self.pieces[core[1:]][:-1]), self.pieces[core][-1]]
        else:
            inner = self.pieces[core][len(core) - (len(unit) - n) :]
        return _changes(counts + [before + x for x in inner])

    def _chunk(self, chunk: str) -> bytes:
        """The steps of a space and the text behind it up to the next space."""
        if chunk.isalpha():
            return _changes(self._piece(" " + chunk))
        if m := _WORD_SIGNS.fullmatch(chunk):
            return self.chunks[m[1]] + self.units[m[2], m[2]]
        return self._steps(" " + chunk)

    # --- texts

    def _stand_in(self, c: str) -> str | None:
        """A character to cut by in place of ``c``, if Python's classes aren't the tokenizer's; else None."""
        one = lambda x: len(self.tok.pre_tokenizer.pre_tokenize_str(x)) == 1
        kind = "letter" if one("a" + c) else "number" if one("1" + c) else "other" if one("!" + c) else "space"
        ours = "space" if c.isspace() else "number" if c.isdecimal() else "letter" if c.isalnum() else "other"
        return None if kind == ours else _STAND_IN[kind]

    def _steps(self, text: str) -> bytes:
        """The steps of a text without added tokens."""
        shape, pattern = text, _UNIT_ASCII
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            pattern = _UNIT
            swaps = {ord(c): new for c in set(text) if (new := self.classes[c])}
            shape = text.translate(swaps)
        body = len(shape.rstrip() if pattern is _UNIT else shape.rstrip(" \t\n\r\x0b\x0c"))
        if shape is text:
            out = [self.units[u, u] for u in pattern.findall(text, 0, body)]
        else:
            spans = [m.span() for m in pattern.finditer(shape, 0, body)]
            out = [self.units[text[a:b], shape[a:b]] for a, b in spans]
        if body < len(text):
            out.append(_changes(self.pieces[text[body:]]))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The steps of a text without added tokens, in parts that begin with white space."""
        if len(text) > SEGMENT:
            cuts = [0]
            while (m := _CUT.search(text, cuts[-1] + SEGMENT)) is not None:
                cuts.append(m.start())
            return b"".join(self._part(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))
        return self._part(text)

    def _part(self, text: str) -> bytes:
        chunks = text.split(" ")
        # words between single spaces are looked up whole; other white space next to a space isn't simple
        if len(chunks) < 3 or "" in chunks or not text.isascii() and any(map(self.classes.__getitem__, set(text))) or _EDGE.search(text):
            return self._steps(text)
        return self._steps(chunks[0]) + b"".join(map(self.chunks.__getitem__, chunks[1:]))

    def steps(self, text: str) -> np.ndarray:
        """By how much the token count changes with each code point of ``text``."""
        if not self.special or not self.special.search(text):
            return np.frombuffer(self._plain(text), "<i2")
        out, at = [], 0
        for m in self.special.finditer(text):  # until it is whole, an added token is ordinary text
            part = np.frombuffer(self._plain(text[at : m.end()]), "<i2").copy()
            part[-1] = 1 - part[m.start() - at : -1].sum()
            out.append(part)
            at = m.end()
        return np.concatenate([*out, np.frombuffer(self._plain(text[at:]), "<i2")])


def counter(json_text: str) -> PrefixCounter:
    """The worker's counter for this tokenizer: loaded once, kept for later tasks."""
    loaded = tokenizers.__dict__.setdefault("_prefix_counters", {})
    key = hashlib.sha256(json_text.encode()).digest()
    if key not in loaded:
        loaded.clear()
        loaded[key] = PrefixCounter(json_text)
    return loaded[key]


@contextlib.contextmanager
def _no_collector() -> Iterator[None]:
    """Without cyclic garbage collection: millions of short-lived lists without cycles."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


_BLOCKS = "array<struct<before:bigint,least:bigint,steps:binary>>"


def _blocks(steps: np.ndarray, size: int) -> tuple[int, list[dict]]:
    """All tokens, and the blocks of a text."""
    out, before = [], 0
    for at in range(0, len(steps), size):
        part = steps[at : at + size]
        counts = part.cumsum(dtype=np.int64)
        out.append({"before": before, "least": before + int(counts.min()), "steps": part.tobytes()})
        before += int(counts[-1])
    return before, out


def _count_rows(json_text: str, size: int):
    kind = pa.list_(pa.struct([("before", pa.int64()), ("least", pa.int64()), ("steps", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(json_text)
        for batch in batches:
            with _no_collector():
                rows = [(len(x.encode()), *_blocks(count.steps(x), size)) for x in batch.column("text").to_pylist()]
            n_bytes, n_tokens, blocks = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(blocks, kind)],
                names=["doc_id", "n_bytes", "n_tokens", "blocks"],
            )

    return run


def prefix_counts(docs: DataFrame, tokenizer_path: str, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, blocks.

    ``blocks`` answers ``tokens_at`` and ``longest_within`` for every prefix;
    written to a table, it answers them for good.  A null text counts as empty:
    no bytes, no tokens, no blocks.  Rows that repeat a doc_id are counted one
    by one; an empty table gives an empty table.  Further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _count_rows(read_json(tokenizer_path), block), f"doc_id {kind}, n_bytes BIGINT, n_tokens BIGINT, blocks {_BLOCKS}"
    )


def tokens_at(n_chars: Column, blocks: str = "blocks", block: int = BLOCK) -> Column:
    """The tokens of the first ``n_chars`` code points (all, if the text is shorter)."""

    @F.arrow_udf("bigint")
    def inside(steps: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(steps.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([None if s is None else int(np.frombuffer(s, "<i2", min(k, len(s) // 2)).sum()) for s, k in rows], pa.int64())

    n = F.greatest(n_chars.cast("long"), F.lit(0))
    last = F.least((n - 1) / block, F.size(blocks) - 1).cast("int")
    found = F.when((n > 0) & (F.size(blocks) > 0), F.get(blocks, last))
    return F.coalesce(found["before"] + inside(found["steps"], n - last * block), F.lit(0))


def longest_within(limit: int, blocks: str = "blocks", block: int = BLOCK) -> Column:
    """The code points of the longest prefix with ``limit`` tokens or fewer."""

    @F.arrow_udf("bigint")
    def inside(steps: pa.Array, before: pa.Array) -> pa.Array:
        rows = zip(steps.to_pylist(), before.to_pylist(), strict=True)
        fits = lambda s, b: np.flatnonzero(b + np.frombuffer(s, "<i2").cumsum(dtype=np.int64) <= limit)
        return pa.array([None if s is None else int(fits(s, b)[-1]) + 1 for s, b in rows], pa.int64())

    nth = F.array_max(F.transform(blocks, lambda b, i: F.when(b["least"] <= limit, i)))
    found = F.when(nth.isNotNull(), F.get(blocks, nth))
    return F.coalesce(inside(found["steps"], found["before"]) + nth.cast("long") * block, F.lit(0))
