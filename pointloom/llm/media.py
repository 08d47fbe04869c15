"""Media columns: signatures located by Aho-Corasick, confirmed by format validators.

``carve`` finds all embedded media: the automaton locates every magic number
in one pass, and only places whose format validates become media, the outermost
ones. ``sniff`` takes those that start at the first byte: its type and its
confirmed length correct what was declared. Validators confirm structure and
lengths: chunk sizes and checksums (PNG, FLAC frames, gzip), tables that must
lie where they are said to (ZIP, PDF), or segments up to an end mark.

``store_texts`` keeps whole texts as 8-bit sound samples (WAVE) under a declared
type that a rule on the text picks and that is mostly wrong, and ``read_stored``
gets them back from the stored bytes through the sniffer. The stored table is
Parquet in a folder that the caller names.

Defined cases: null texts count as empty; null media have type null and no
length; empty media are "empty"; bytes that no validator confirms are
application/octet-stream, or text/plain if they are UTF-8 without control
characters; a null declared type is always corrected; very long texts are stored
whole; repeated rows are handled each; columns other than those named are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

FRAME = 576
RATE = 8000


def _png(d: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        end = p + 12 + size
        if (p == at + 8) != (kind == b"IHDR") or end > len(d) or struct.unpack_from(">I", d, end - 4)[0] != zlib.crc32(d[p + 4 : end - 4]):
            return 0
        if kind == b"IEND":
            return end - at
        p = end
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 14 > len(d):
        return 0
    flags = d[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while p < len(d):
        mark = d[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x2C and p + 11 <= len(d):
            p += 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 128 else 0)
        elif mark == 0x21:
            p += 2
        else:
            return 0
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return 0


#: In compressed picture data: a mark that is neither a stuffed byte, a restart nor filling.
_JPEG_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg(d: bytes, at: int) -> int:
    p, scanned = at + 2, False
    while p + 2 <= len(d):
        if d[p] != 0xFF or d[p + 1] in (0, 0xFF):
            return 0
        mark = d[p + 1]
        if mark == 0xD9:
            return p + 2 - at if scanned else 0
        size = int.from_bytes(d[p + 2 : p + 4], "big")
        if size < 2 or p + 4 > len(d):
            return 0
        p += 2 + size
        if mark == 0xDA:
            found = _JPEG_MARK.search(d, p)
            if found is None:
                return 0
            p, scanned = found.start(), True
    return 0


def _riff(kind: bytes) -> Callable[[bytes, int], int]:
    def check(d: bytes, at: int) -> int:
        if at + 12 > len(d) or d[at + 8 : at + 12] != kind:
            return 0
        end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
        if end > len(d):
            return 0
        p, names = at + 12, set()
        while p + 8 <= end:
            names.add(d[p : p + 4])
            size = struct.unpack_from("<I", d, p + 4)[0]
            p += 8 + size + size % 2
        needs = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}}.get(kind, set())
        return end - at if p == end and names and needs <= names else 0

    return check


def _gzip(d: bytes, at: int) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    z = zlib.decompressobj(31)
    p, step = at, 1 << 16
    try:
        while p < len(d) and not z.eof:
            z.decompress(d[p : p + step])
            p += step
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


def _zip(d: bytes, at: int) -> int:
    end = d.find(b"PK\x05\x06", at)
    while 0 <= end <= len(d) - 22:
        size, start, note = struct.unpack_from("<IIH", d, end + 12)
        if at + start + size == end and end + 22 + note <= len(d) and d[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return end + 22 + note - at
        end = d.find(b"PK\x05\x06", end + 1)
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    ok = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= start < size <= len(d) - at
    return size if ok else 0


_PDF_END = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")


def _pdf(d: bytes, at: int) -> int:
    """Up to the last end mark whose table lies where it says, counted from this header; a later document's do not."""
    if not d[at + 5 : at + 6].isdigit():
        return 0
    length, p = 0, at
    while found := _PDF_END.search(d, p):
        table = at + int(found[1])
        if table < found.start() and _PDF_TABLE.match(d, table):
            length = found.end() - at
        elif length or d.find(b"%PDF-", at + 5, found.start()) >= 0:
            break  # another document has begun
        p = found.end()
    return length


def _ogg(d: bytes, at: int) -> int:
    p = at
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\0":
        n = d[p + 26]
        if p + 27 + n > len(d):
            break
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d):
            break
        last, p = d[p + 5] & 4, end
        if last:
            return p - at
    return 0


def _remainders(width: int, rule: int) -> list[int]:
    """The table of a checksum of ``width`` bits that starts with the high bit."""
    table, top = [], 1 << width - 1
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ rule if x & top else x << 1) & (1 << width) - 1
        table.append(x)
    return table


_CRC8, _CRC16 = _remainders(8, 0x07), _remainders(16, 0x8005)


def _flac_frame(d: bytes, p: int) -> tuple[int, int]:
    """Length of the frame header at ``p`` and the samples of its frame; (0, 0) if it is none."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 3] & 1:
        return 0, 0
    block, rate = d[p + 2] >> 4, d[p + 2] & 15
    more = next((k for k in range(8) if not d[p + 4] & 0x80 >> k), 8)
    if block == 0 or rate == 15 or more in (1, 8) or d[p + 3] >> 4 > 10:
        return 0, 0
    q = p + 4 + max(1, more)
    wide = {6: 1, 7: 2}.get(block, 0)
    if wide:
        samples = int.from_bytes(d[q : q + wide], "big") + 1
    else:
        samples = 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    q += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if q >= len(d):
        return 0, 0
    crc = 0
    for x in d[p:q]:
        crc = _CRC8[crc ^ x]
    return (q + 1 - p, samples) if crc == d[q] else (0, 0)


def _flac(d: bytes, at: int) -> int:
    p, first, last = at + 4, True, False
    total = 0
    while not last:
        if p + 4 > len(d):
            return 0
        kind, size = d[p] & 127, int.from_bytes(d[p + 1 : p + 4], "big")
        if first != (kind == 0) or (first and size != 34) or p + 4 + size > len(d):
            return 0
        if first:
            total = int.from_bytes(d[p + 17 : p + 22], "big") & (1 << 36) - 1
        first, last, p = False, d[p] >> 7, p + 4 + size
    done = 0
    while not total or done < total:
        head, samples = _flac_frame(d, p)
        if not head:
            return p - at if done and not total else 0
        # a frame ends where its checksum comes out, if another begins there or all samples are there
        crc, end, enough = 0, 0, bool(total) and done + samples >= total
        for q in range(p, len(d)):
            crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ d[q]]
            if crc == 0 and q + 1 - p > head + 2:
                if enough or _flac_frame(d, q + 1)[0]:
                    end = q + 1
                    break
                end = end or (0 if total else q + 1)
        if not end:
            return 0
        done, p = done + samples, end
    return p - at


#: Magic bytes, their place from the start of the medium, its type and its validator.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE")),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP")),
    (b"AVI ", 8, "video/avi", _riff(b"AVI ")),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-1.", 0, "application/pdf", _pdf),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
)
#: The first bytes that hold every signature of a medium that starts there.
HEAD = max(len(magic) + place for magic, place, *_ in SIGNATURES)
#: Names of one type that are in use.
SAME = {"audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "image/jpg": "image/jpeg", "application/x-gzip": "application/gzip", "audio/x-flac": "audio/flac"}
#: Types that stored texts are declared as.
DECLARED = ("audio/x-wav", "application/octet-stream", "text/plain", "image/png", None)


def _automaton():
    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


_built: list = []


def found_at(data: bytes) -> Iterator[tuple[int, int]]:
    """Where each signature says that a medium starts, in order, and the signature."""
    if not _built:
        _built.append(_automaton())
    for end, k in _built[0].iter(data.decode("latin-1")):
        magic, place, *_ = SIGNATURES[k]
        start = end + 1 - len(magic) - place
        if start >= 0 and (not place or data[start : start + 4] == b"RIFF"):
            yield start, k


def carve(data: bytes, skip: int = 0) -> list[tuple[int, int, str]]:
    """(start, length, type) of the outermost valid media from byte ``skip`` on."""
    out, upto = [], skip
    for start, k in sorted(found_at(data)):
        if start >= upto and (length := SIGNATURES[k][3](data, start)):
            out.append((start, length, SIGNATURES[k][2]))
            upto = start + length
    return out


def sniff(data: bytes | None) -> tuple[str | None, int]:
    """Type and confirmed length of a medium that starts at the first byte."""
    if data is None:
        return None, 0
    if not data:
        return "empty", 0
    for start, k in sorted(found_at(data[:HEAD])):
        if start == 0 and (length := SIGNATURES[k][3](data, 0)):
            return SIGNATURES[k][2], length
    try:
        plain = all(c >= " " or c in "\t\n\r\f" for c in data.decode())
    except UnicodeDecodeError:
        plain = False
    return ("text/plain" if plain else "application/octet-stream"), len(data)


def corrected(declared: str | None, found: str | None) -> bool:
    """Whether the declared type is another than the one that was found; names of one type are the same."""
    return SAME.get(declared, declared) != found


def wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file of unsigned 8-bit samples."""
    odd = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(data: bytes) -> tuple[dict[str, int], bytes]:
    """Format and samples of a valid WAVE file."""
    p, about, samples = 12, {}, b""
    while p + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, p)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, p + 8)
            about = {"code": code, "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data":
            samples = data[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    return about, samples


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, lengths, declared = [], [], []
        for t in batch.column(1).cast(pa.binary()):
            raw = t.as_py()
            media.append(wave(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)))
            lengths.append(len(raw))
            declared.append(DECLARED[zlib.crc32(raw) % len(DECLARED)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, n_bytes, declared type and media of every text."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(F.col(text_col)).alias("text"))
    stored = picked.mapInArrow(_store, "doc_id long, n_bytes long, declared string, media binary")
    stored.write.option("compression", "zstd").parquet(path)


def _feature(kind: str, about: dict[str, int], samples: bytes, embedded: list[tuple[int, int, str]]) -> str:
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / max(1, len(x))
    mean = float(p @ np.arange(256))
    rms = float(np.sqrt(p @ (np.arange(256) - 128.0) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    inner = ",".join(f"{k}@{a}+{n}" for a, n, k in embedded)
    return f"{kind};channels={about['channels']};rate={about['rate']};bits={about['bits']};frames={len(x)};mean={mean:.4f};rms={rms:.4f};entropy={entropy:.4f};embedded=[{inner}]"


_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("declared", pa.string()), ("media_type", pa.string()), ("was_corrected", pa.bool_())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc, n, declared, data = (batch.column(k)[i].as_py() for k in range(4))
            kind, length = sniff(data)
            if kind != "audio/wav" or length != len(data):
                raise ValueError(f"the stored medium of document {doc} is damaged: {kind}, {length} of {len(data)} bytes")
            about, samples = samples_of(data)
            inner = carve(data, skip=44)
            rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), _feature(kind, about, samples, inner), declared, kind, corrected(declared, kind)))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _READ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _READ.types, strict=True)], schema=_READ)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Digests and features of every stored medium, from its bytes; the declared type beside the corrected one."""
    stored = spark.read.schema("doc_id long, n_bytes long, declared string, media binary").parquet(path)
    return stored.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, was_corrected boolean")


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(0).to_pylist()
        kinds, lengths = zip(*map(sniff, data), strict=True) if data else ((), ())
        inner = [[] if d is None else [{"start": a, "length": n, "type": k} for a, n, k in carve(d)] for d in data]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        rest = batch.columns[1:]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(inner, kind)], names=[*batch.schema.names[1:], "sniffed_type", "confirmed_length", "carved"])


def sniff_media(media: DataFrame, data_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the sniffed type, its confirmed length, and all media carved out."""
    d = media.select(F.col(data_col).alias("__data"), *[F.col(c) for c in keep])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields[1:])
    return d.mapInArrow(_types, f"{kept}sniffed_type string, confirmed_length bigint, carved array<struct<start: bigint, length: bigint, type: string>>")
