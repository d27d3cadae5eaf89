"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

#: Distinct words and pieces whose ids a Python worker keeps, each, unless told otherwise.
KNOWN = 600_000
ID_TYPE = np.dtype("<u4")

# Characters of which is known what a byte-level tokenizer's own split takes them for: letters, digits, space, other signs.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SPACE = r"\t\n\x0b\x0c\r\x20"
_SIGN = r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f\u2010-\u2027\u20ac"
_UNKNOWN = re.compile(f"[^{_LETTER}0-9{_SPACE}{_SIGN}]")
_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)|\x20?[{_LETTER}]+|\x20?[0-9]+|\x20?[{_SIGN}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LONG = 64
_TOGETHER = 1_000  # words that the library gets at once
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # neither letters nor digits, and no part of contractions


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids, equal to the library's for the whole text.

    A byte-level tokenizer splits a text into words before it looks for tokens, and no token crosses them. Texts of
    letters, digits, spaces and signs whose kind is known are split here in the same way. A word is kept when it comes
    a second time while it is remembered, so that the many that come once don't crowd out the others. All other texts are
    cut at a space between two other characters, where a word always begins, and pieces of plain words again at line ends
    and before closing punctuation. ``limit`` bounds what is kept of each kind, not what comes out. All other tokenizers get whole texts.
    """

    def __init__(self, path: str, limit: int = KNOWN):
        self.tokenizer = _uncached(Tokenizer.from_file(path))
        self.limit = limit
        self.once: dict[str, bytes] = {}
        self.words = _Words(self.once)
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes | None] = {}
        self.loose: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.long: list[tuple[dict, str]] = []
        self.mark = self._mark()
        self.bare = self._bare() if self.mark is not None else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mark is None:
            return [_bytes(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [self.mark not in text and not _UNKNOWN.search(text) for text in texts]
        words = iter(self._encode_words([text for text, known in zip(texts, plain) if known]))
        others = iter(self._encode_pieces([text for text, known in zip(texts, plain) if not known]))
        return [next(words) if known else next(others) for known in plain]

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        get, holes = self.words.__getitem__, self.words.holes
        fresh: dict[str, bytes] = {}
        try:
            found = [list(map(get, _WORDS.findall(text))) for text in texts]
            self._encode_new(fresh, holes, self.bare)
            for x, ids in fresh.items():
                holes[x] += ids
            encoded = [b"".join(ids) for ids in found]
        finally:  # no place may stay empty
            for x in holes:
                del self.words[x]
            holes.clear()
        self.once.update((x, ids) for x, ids in fresh.items() if len(x) <= _LONG)
        self._forget()
        return encoded

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        pieces = [text.split(" ") for text in texts]
        self._learn(self.first, {p[0] for p in pieces}, "")
        self._learn(self.inner, set().union(*pieces), " ")
        found, odd = [], []
        for i, p in enumerate(pieces):
            try:
                found.append(self.first[p[0]] + b"".join(map(self.inner.__getitem__, p[1:])))
            except TypeError:  # white space next to a space
                found.append(b"")
                odd.append(i)
        if odd:
            cut = [_SAFE_SPACE.split(texts[i]) for i in odd]
            self._learn(self.first, {p[0] for p in cut}, "")
            self._learn(self.loose, set().union(*cut), " ")
            for i, p in zip(odd, cut):
                found[i] = self.first[p[0]] + b"".join(map(self.loose.__getitem__, p[1:]))
        self._forget()
        return found

    def _learn(self, known: dict, pieces: set[str], before: str) -> None:
        new = list(pieces.difference(known))
        cut = [_parts(before + x) for x in new]
        self._encode_new(self.parts, set().union(*cut).difference(self.parts))
        for x, parts in zip(new, cut):
            known[x] = self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))
        self.long += [(known, x) for x in new if len(x) > _LONG]
        if known is self.inner:
            for x in new:
                if not x or x[0].isspace() or x[-1].isspace():
                    known[x] = None

    def _encode_new(self, known: dict[str, bytes], new: Iterable[str], tokenizer: Tokenizer | None = None) -> None:
        tokenizer = tokenizer or self.tokenizer
        plain = [x for x in new if self.mark not in x]
        for at in range(0, len(plain), _TOGETHER):
            part = plain[at : at + _TOGETHER]
            ids = _array(tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            raw, starts = ids.tobytes(), np.append(0, ends[:-1] + 1)
            size = ID_TYPE.itemsize
            for x, start, end in zip(part, (starts * size).tolist(), (ends * size).tolist()):
                known[x] = raw[start:end]
        for x in new:
            if self.mark in x:
                known[x] = _bytes(self.tokenizer.encode(x, add_special_tokens=False).ids)
        self.long += [(known, x) for x in new if len(x) > _LONG]

    def _forget(self) -> None:
        for known, x in self.long:
            known.pop(x, None)
        self.long.clear()
        for known in (self.words, self.once, self.first, self.inner, self.loose, self.parts):
            if len(known) > self.limit:
                known.clear()

    def _mark(self) -> str | None:
        """A special token to put between pieces, if texts may be cut at spaces at all."""
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        strict = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added)
        if made.get("normalizer") or not plain or not strict or not added:
            return None
        self.mark_id = added[0]["id"]
        return added[0]["content"]

    def _bare(self) -> Tokenizer:
        """The same tokenizer for single words: it doesn't look for words in them once more."""
        made = json.loads(self.tokenizer.to_str())
        made["pre_tokenizer"]["use_regex"] = False
        return _uncached(Tokenizer.from_str(json.dumps(made)))


class _Words(dict):
    """Ids of words, each looked up once an occurrence. A word seen ``once`` before is kept; a new one gets an empty
    place, to be filled before the ids are joined."""

    def __init__(self, once: dict[str, bytes]):
        super().__init__()
        self.once = once
        self.holes: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.once.pop(word, None)
        if ids is None:
            ids = self.holes[word] = bytearray()
        self[word] = ids
        return ids


def _uncached(tokenizer: Tokenizer) -> Tokenizer:
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # every word it gets is new to it
    return tokenizer


def _parts(piece: str) -> list[str]:
    """``piece``, which may start with a space, cut where it is plain to see that no token goes across."""
    if "\n" not in piece:
        word = piece.rstrip(_TAIL)
        return [word, piece[len(word) :]] if len(word) < len(piece) and word.lstrip(" ").isalpha() else [piece]
    lines = piece.split("\n")
    if not all(x and not x[-1].isspace() and not (i and x[0].isspace()) for i, x in enumerate(lines)):
        return [piece]  # white space runs: left to the library
    parts = _parts(lines[0])
    for line in lines[1:]:
        parts.append("\n")
        parts += _parts(line)
    return parts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = KNOWN) -> Encoder:
    """One for each Python worker, so that its pieces stay known from task to task."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]


def forget_encoders() -> None:
    """Give back the memory of this Python worker's encoders, where later steps of a job need none."""
    _encoders.clear()


def _array(ids: list[int]) -> np.ndarray:
    return np.array(ids, dtype=ID_TYPE)


def _bytes(ids: list[int]) -> bytes:
    return _array(ids).tobytes()
