"""Whole-text encoding with a byte-pair model of the tokenizers library.

The model drops white space, so the ids of a text are the ids of its chunks
between ASCII white space in order. Chunks repeat a lot; each worker remembers
the ids of those it saw and of their pieces, up to a number of bytes, and asks
the library for the rest. A piece is remembered as the chunk that consists of
it, so nothing is held twice. Very long chunks (texts without blanks) are never
remembered.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Bytes of keys, values and their objects that each of a memo's two generations holds.
REMEMBER = 48 << 20
#: Longer keys are worked out each time: they hardly come again.
LONGEST = 256
#: Bytes that a key and its value take beside their contents.
OVERHEAD = 200
_LATIN = re.compile(r"[\x00-įı-ſ]*")
#: The model's own splitting rule, where letters and digits are those up to U+017F.
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼½¾]"
    r"|[^\x09-\x0d\x20\x85\xa0a-zªµºß-öø-ÿĀ-ſ0-9²³¹¼½¾]+"
)
#: Normaliser and splitter that the short way reproduces; others go to the library whole.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level models write each byte as a printable letter: itself, or 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in set(shown) else next(spare)) for b in range(256)}


class Memo(dict):
    """key -> value, made by ``make`` when missing; bounded in bytes, and what is in use stays.

    When a generation is full it becomes the old one; a key that is asked for
    again moves to the new one, and the others go with the next change. Long
    keys are not remembered.
    """

    def __init__(self, make, size: int = REMEMBER, longest: int = LONGEST):
        super().__init__()
        self.make, self.size, self.longest, self.old, self.held = make, size, longest, {}, 0

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += len(key) + len(value) + OVERHEAD
        self[key] = value
        return value


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.short = (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and split[0].get("pattern") == {"Regex": _RULE}
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.model = self.library.model
        self.letters = _byte_letters()
        self.chunks = Memo(self._chunk, 2 * REMEMBER)  # chunks and pieces

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        letters = piece.decode("latin-1")
        if not (letters.isascii() and letters.isprintable()):
            letters = letters.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        low = chunk.lower()  # of ASCII letters
        if low.isalpha():
            return self._piece(low) if low == chunk else self.chunks[low]
        if low[:-1].isalpha() and low[-1] < 128:
            return self.chunks[low[:-1]] + self.chunks[low[-1:]]
        text = chunk.decode()
        if not chunk.isascii() and not _LATIN.fullmatch(text):
            return self._whole(text)
        pieces = [p.encode() for p in _PIECE.findall(text.lower())]
        if len(pieces) != 1:
            return b"".join(map(self.chunks.__getitem__, pieces))
        return self._piece(chunk) if pieces[0] == chunk else self.chunks[pieces[0]]

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian 32-bit integers, without special tokens."""
        if not self.short or any(s in text for s in self.specials):
            return self._whole(text.decode())
        return b"".join(map(self.chunks.__getitem__, text.split()))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of ``path``, one a worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
