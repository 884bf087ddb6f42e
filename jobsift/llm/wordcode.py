"""Encoding by distinct words.

For a tokenizer that drops white space before it merges, the ids of a text are
the ids of its words one after another.  A worker therefore keeps the ids of
words it has met, asks the tokenizer for new ones only, and joins.  The memo
has a fixed size and is emptied when full, which changes speed, not ids.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import tokenizers

#: Words that a worker remembers (about 200 bytes each), and bytes of a text that are split at once.
MEMO_WORDS, SEGMENT = 700_000, 1 << 20
_BLOCK = 20_000
_SPACE = b" \t\n\x0b\x0c\r"
#: A word and the ASCII punctuation behind it (no apostrophe, which begins contractions).
_TAIL = re.compile(rb"(?s)(.*[^!-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)}


class _Memo(dict):
    """Ids by word; a word that isn't there gives None and is noted, in order."""

    def __init__(self) -> None:
        self.missed: list[bytes] = []

    def __missing__(self, word: bytes) -> None:
        self.missed.append(word)


def latin(word: str) -> bool:
    """Only Latin-1 letters that lower-casing and NFC change one by one."""
    return word.isalpha() and not any(c in word for c in "\xaa\xb5\xba") and max(word) <= "\xff"


class WordEncoder:
    """The tokenizer of a ``tokenizers`` JSON text; ids come as little-endian uint32 bytes."""

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tok = tokenizers.Tokenizer.from_str(json_text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        if any(ids(f"ab{c}cd") != ids("ab") + ids("cd") for c in _SPACE.decode()):
            raise ValueError("this tokenizer keeps white space; it has no ids by word")
        self.folds = all(ids(f"x{chr(c)}y") == ids(f"x{chr(c + 32)}y") for c in range(65, 91))
        self.tokens = None if self.tok.decoder else [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.memo = _Memo()
        self.punctuation = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
        self.model, self.letters = self.tok.model, byte_letters()
        # the model alone may be asked for a word that is one byte-level pre-token: tried on samples
        probe = ["the", "zzyzxqj", "éàüß", "ÀÉÖØÞ", "naïveté", "a" * 40, "öffentlichkeit"]
        self.plain = self.folds and all(
            [t.id for t in self.model.tokenize(w.lower().encode().decode("latin-1").translate(self.letters))] == ids(w) for w in probe
        )

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, raw: bytes) -> list[bytes]:
        return (raw.lower() if self.folds else raw).split()

    def learn(self, words: Iterable[bytes]) -> None:
        """Bring ``words`` into the memo: a word's letters and the punctuation behind it are separate pre-tokens."""
        new = set(words)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
        ends, whole = [], set()
        for w in new:
            m = _TAIL.fullmatch(w) if w[-1:] in self.punctuation else None
            if m and (last := m[1].decode("utf-8", "replace")[-1]).isalnum() and last <= "\xff":  # stays a letter or digit when folded
                ends.append((w, m[1], m[2]))
                whole.update((m[1], m[2]))
            else:
                whole.add(w)
        others, tokenize = [], self.model.tokenize
        for w in whole:
            if w in self.memo:
                continue
            if self.plain and w.isalpha():  # ASCII letters, already folded
                ids = [t.id for t in tokenize(w.decode())]
            elif self.plain and latin(text := w.decode("utf-8", "replace")):
                ids = [t.id for t in tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
            else:
                others.append(w)
                continue
            self.memo[w] = struct.pack(f"<{len(ids)}I", *ids)
        for i in range(0, len(others), _BLOCK):
            block = others[i : i + _BLOCK]
            texts = [w.decode("utf-8", "replace") for w in block]
            for w, e in zip(block, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.memo[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        self.memo.update([(w, self.memo[stem] + self.memo[tail]) for w, stem, tail in ends])

    def encode_all(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as the tokenizer's ``encode`` gives them."""
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived words without cycles
        try:
            return self._encode_all(raws)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, raws: list[bytes]) -> list[bytes]:
        out = [b""] * len(raws)
        todo: list[tuple[int, list[list[bytes]]]] = []
        held = 0
        for i, raw in enumerate(raws):
            if any(s in raw for s in self.special):  # found before anything is normalised
                out[i] = self.ids(raw.decode("utf-8", "replace"))
                continue
            if len(raw) > SEGMENT:
                out[i] = b"".join(self._joined(self.words(part)) for part in segments(raw))
                continue
            todo.append((i, self.words(raw)))
            held += len(raw)
            if held > SEGMENT:
                self._flush(todo, out)
                todo, held = [], 0
        self._flush(todo, out)
        return out

    def _flush(self, todo: list, out: list[bytes]) -> None:
        """Look the words up, learn what is missing in one go, join."""
        look, missed, found = self.memo.__getitem__, self.memo.missed, []
        for i, words in todo:
            ids = list(map(look, words))
            found.append((i, ids, missed[:]))
            missed.clear()
        new = {w for _, _, gaps in found for w in gaps}
        if new:
            self.learn(new)
        for i, ids, gaps in found:
            at = -1
            for w in gaps:
                at = ids.index(None, at + 1)
                ids[at] = self.memo[w]
            out[i] = b"".join(ids)

    def _joined(self, words: list[bytes]) -> bytes:
        out = [b""]
        self._flush([(0, words)], out)
        return out[0]

    def encode(self, raw: bytes) -> bytes:
        return self.encode_all([raw])[0]

    def decode(self, ids: bytes) -> str:
        """As the tokenizer's ``decode(ids, skip_special_tokens=False)``."""
        each = np.frombuffer(ids, "<u4").tolist()
        if self.tokens is None:
            return self.tok.decode(each, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, each))


def segments(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``SEGMENT`` bytes, cut at white space."""
    at = 0
    while len(raw) - at > SEGMENT:
        cut = max(raw.rfind(c, at + 1, at + SEGMENT) for c in (b" ", b"\n"))
        if cut < 0:
            cut = min((x for x in (raw.find(c, at + SEGMENT) for c in (b" ", b"\n")) if x >= 0), default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def encoder(json_text: str) -> WordEncoder:
    """The worker's encoder for this tokenizer: loaded once, kept for later tasks."""
    loaded = tokenizers.__dict__.setdefault("_encoders_by_words", {})
    key = hashlib.sha256(json_text.encode()).digest()
    if key not in loaded:
        loaded.clear()
        loaded[key] = WordEncoder(json_text)
    return loaded[key]


def read_json(path: str) -> str:
    """A tokenizer's JSON (a megabyte or two, whatever the corpus), read by the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
