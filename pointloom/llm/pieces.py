"""SentencePiece models run by the tokenizers library.

``parse`` reads the model's protobuf; ``build`` makes a tokenizer of the other
library from it: the precompiled character map and space rules as normaliser,
the metaspace marker, unigram scores or byte-pair merges in the order of their
scores, byte fallback, and the decoder.

No piece of such a model runs over a space marker, nor over a line feed
(``build`` refuses models where one does), so the ids of a text are those of
its chunks in order. A worker remembers chunks up to a number of bytes; chunks
that are missing are encoded in batches by the library's threads, and each is
held against the SentencePiece library, so parity is verified on everything
that is encoded.

Defined cases for ``encode_documents``: a null text counts as empty and has no
ids; a very long text is encoded whole, its very long chunks (texts without
blanks) without being remembered; repeated rows are encoded each; other columns
are carried along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from pointloom.llm import common

MARKER = "▁"
#: Bytes that each of two generations of remembered chunks takes.
REMEMBER = 40 << 20
#: Longer chunks are encoded each time.
LONGEST = 256
#: Bytes of text that are cut into chunks at once.
AT_ONCE = 1 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


@dataclass
class Model:
    """What the protobuf holds; defaults are the format's own."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            if wire == 2:
                size, at = varint(at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} in a model file")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Field numbers are those of the published model format."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append(f.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", f.get(2, bytes(4)))[0])
            m.kinds.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap = f.get(2, b"")
            m.dummy_prefix, m.remove_extra_spaces, m.escape_spaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Every way to put a piece together from two pieces, best scores first."""
    ids = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] in (NORMAL, USER_DEFINED)}
    found = []
    for p, i in ids.items():
        ways = [(ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found += [(-m.scores[i], a, b) for a, b in sorted(ways)]
    found.sort(key=lambda x: x[0])
    return [(m.pieces[a], m.pieces[b]) for _, a, b in found]


def build(m: Model) -> Tokenizer:
    if not m.escape_spaces:
        raise ValueError("models that do not mark spaces are not supported")
    for p, kind in zip(m.pieces, m.kinds, strict=True):
        if kind == NORMAL and (MARKER in p.lstrip(MARKER) or "\n" in p[1:] or ("\n" in p and len(p) > 1)):
            raise ValueError("a piece runs over a space marker or a line feed")
    unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
    if m.kind == UNIGRAM:
        inner = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unknown, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        inner = models.BPE({p: i for i, p in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind}")
    t = Tokenizer(inner)
    rules = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:
        rules += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        rules.append(normalizers.Prepend(MARKER))
    t.normalizer = normalizers.Sequence([*rules, normalizers.Replace(" ", MARKER)])
    t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}\n]*|\n+|[^{MARKER}\n]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    user = [AddedToken(p, normalized=False, special=False) for p, k in zip(m.pieces, m.kinds, strict=True) if k == USER_DEFINED]
    if user:
        t.add_tokens(user)
    return t


class Encoder:
    """Whole texts to ids and back; ``bad`` gathers chunks on which the two libraries differ."""

    _CHUNK = re.compile(rb" +[^ \n]*|\n+|[^ \n]+")

    def __init__(self, path: str, verify: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.full = build(self.model)
        self.bare = Tokenizer(self.full.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra_spaces and USER_DEFINED not in self.model.kinds
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.memo, self.old, self.bad, self.held = {}, {}, set(), 0
        self.prefix = b" " if self.model.dummy_prefix else b""
        self.lone = array("I", self.bare.encode(MARKER).ids).tobytes()
        self.lone_line = self.lone + array("I", self.bare.encode("\n").ids).tobytes()
        self.written = [self._bytes(p, k) for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else piece.replace(MARKER, " ").encode() if kind != UNKNOWN else " ⁇ ".encode()

    def normal(self, text: bytes) -> bytes:
        """The text as the model sees it: markers as spaces, the leading one included."""
        if not text:
            return b""
        if not self.plain:
            return self.full.normalizer.normalize_str(text.decode()).replace(MARKER, " ").encode()
        return self.prefix + (text.replace(MARKER.encode(), b" ") if MARKER.encode() in text else text)

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Remember the ids of ``chunks``; those of very long ones are only returned."""
        new, passing = [], {}
        for c in chunks:
            found = self.old.get(c)
            if found is None:
                new.append(c)
            else:
                self.memo[c] = found
                self.held += len(c) + len(found) + 200
        done = self.bare.encode_batch_fast([c.decode().replace(" ", MARKER) for c in new], add_special_tokens=False)
        ids_of = {c: array("I", e.ids).tobytes() for c, e in zip(new, done, strict=True)}
        for c, ids in ids_of.items():
            if len(c) > LONGEST:
                passing[c] = ids
            else:
                self.memo[c] = ids
                self.held += len(c) + len(ids) + 200
        if self.check is not None:
            # the other library puts a marker before each text: in place of a chunk's own, or before a line feed
            shown = [c[1:] if self.prefix and c[:1] == b" " else c if not self.prefix or c[:1] == b"\n" else b"\n" + c for c in new]
            theirs = self.check.encode([c.decode() for c in shown], num_threads=1)
            for c, text, ids in zip(new, shown, theirs, strict=True):
                before = b"" if not self.prefix or c[:1] == b" " else self.lone if c[:1] == b"\n" else self.lone_line
                # a lone space is nothing but that marker there
                if array("I", ids).tobytes() != before + ids_of[c] and text:
                    self.bad.add(c)
        return passing

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bool]]:
        """For each text its ids, little-endian 32-bit, and whether the two libraries agree."""
        cut = [self._CHUNK.findall(self.normal(t)) for t in texts]
        if self.held >= REMEMBER:
            self.memo, self.old, self.held = {}, self.memo, 0
            self.bad.intersection_update(self.old)
        missing = set().union(*cut).difference(self.memo)
        passing = self._learn(missing) if missing else {}
        find = self.memo.__getitem__ if not passing else lambda c: passing[c] if c in passing else self.memo[c]
        out = [(b"".join(map(find, c)), not self.bad or self.bad.isdisjoint(c)) for c in cut]
        self.bad.difference_update(passing)
        return out

    def decode(self, ids) -> bytes:
        out = b"".join(map(self.written.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out


_loaded: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _coder(path: str):
    names = ["ids", "n_tokens", "ids_crc32", "parity", "round_trip"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            texts, at = batch.column(0).cast(pa.binary()), 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < AT_ONCE:
                    part.append(texts[at].as_py())
                    size, at = size + len(part[-1]), at + 1
                rows = []
                for text, (ids, parity) in zip(part, encoder.encode_batch(part), strict=True):
                    values = array("I", ids)
                    normal = encoder.normal(text)
                    same = encoder.decode(values) == normal[len(encoder.prefix) :]
                    rows.append((values, len(values), zlib.crc32(ids), parity, same))
                cols = list(zip(*rows, strict=True))
                ids = pa.ListArray.from_arrays(pa.array([0, *_running(cols[1])], pa.int32()), pa.array(np.frombuffer(b"".join(v.tobytes() for v in cols[0]), np.int32)))
                new = [ids, *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True))]
                rest = [batch.column(i).slice(at - len(part), len(part)) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *new], names=[*batch.schema.names[1:], *names])

    return code


def _running(lengths) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total


def encode_documents(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every document with ids, n_tokens, ids_crc32, parity and round_trip.

    parity: both libraries agree on every chunk of the text. round_trip: the
    decoded ids are the normalised text.
    """
    d = docs.select(common.whole_text(F.col(text_col)).alias("__text"), *[F.col(c) for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(_coder(path), f"{kept}{', ' if kept else ''}ids array<int>, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean")
