"""Patched frame-of-reference blocks for token ids.

A shard is one self-describing byte string of little-endian 32-bit words:

    magic "PFR1" | block size | ids | documents | blocks
    length of each document | start of each block, in words from the first block
    blocks: minimum | width + 256 * exceptions | packed low bits
            | position of each exception, four a word | offset of each exception

Each block stores ids minus the block's minimum at the width that its chosen
percentile of offsets needs; offsets that are wider go to the exception list
in full. The last block is filled up with its minimum. Starts take two words.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.9
HEAD = 2
CHUNK = 8192


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact for 32-bit values."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _spans(rows: np.ndarray):
    return np.array_split(rows, -(-len(rows) // CHUNK)) if len(rows) else ()


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One shard of ``ids`` (below 2**32) that documents of ``lengths`` make up."""
    if block not in (32, 64, 96, 128, 160, 192, 224, 256):
        raise ValueError("a block holds a multiple of 32 ids, 256 at most")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n, blocks = len(ids), -(-len(ids) // block)
    head = np.array([block, n, len(lengths), blocks], dtype="<u4").tobytes()
    sizes = np.asarray(lengths, dtype="<u4").tobytes()
    if not n:
        return MAGIC + head + sizes
    full = np.empty(blocks * block, dtype="<u4")
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * block :].min()
    full = full.reshape(blocks, block)
    low = full.min(axis=1)
    off = full - low[:, None]
    rank = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    width = _bits(np.partition(off, rank, axis=1)[:, rank])
    wide = off > ((1 << width) - 1).astype("<u4")[:, None]
    exceptions = wide.sum(axis=1)
    packed = block // 32 * width
    size = HEAD + packed + (exceptions + 3) // 4 + exceptions
    start = np.zeros(blocks, dtype="<u8")
    np.cumsum(size[:-1], out=start[1:])
    out = np.zeros(int(size.sum()), dtype="<u4")
    at = start.astype(np.int64)
    out[at] = low
    out[at + 1] = width + 256 * exceptions
    for w in map(int, np.unique(width)):
        for part in _spans(np.flatnonzero(width == w)) if w else ():
            v = (off[part] & np.uint32((1 << w) - 1)).T.copy()
            words = np.zeros((block // 32 * w, len(part)), dtype="<u4")
            for j in range(block):
                k, s = divmod(j * w, 32)
                words[k] |= v[j] << np.uint32(s)
                if s + w > 32:
                    words[k + 1] |= v[j] >> np.uint32(32 - s)
            out[at[part][:, None] + HEAD + np.arange(len(words))] = words.T
    row, pos = np.nonzero(wide)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = at[row] + HEAD + packed[row]
        out.view(np.uint8)[4 * base + nth] = pos
        out[base + (exceptions[row] + 3) // 4 + nth] = off[row, pos]
    return b"".join((MAGIC, head, sizes, start.tobytes(), out.tobytes()))


def _sections(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a shard of this format")
    block, n, docs, blocks = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
    lengths = np.frombuffer(data, "<u4", docs, 20)
    start = np.frombuffer(data, "<u8", blocks, 20 + 4 * docs).astype(np.int64)
    return block, n, lengths, start, np.frombuffer(data, "<u4", offset=20 + 4 * docs + 8 * blocks)


def _unpack(body: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Ids of the blocks that start at ``at``, one row a block."""
    low, width, exceptions = body[at], (body[at + 1] & 255).astype(np.int64), (body[at + 1] >> 8).astype(np.int64)
    off = np.zeros((len(at), block), dtype="<u4")
    for w in map(int, np.unique(width)):
        for part in _spans(np.flatnonzero(width == w)) if w else ():
            words = body[at[part][:, None] + HEAD + np.arange(block // 32 * w)].T.copy()
            v = np.empty((block, len(part)), dtype="<u4")
            for j in range(block):
                k, s = divmod(j * w, 32)
                np.right_shift(words[k], np.uint32(s), out=v[j])
                if s + w > 32:
                    v[j] |= words[k + 1] << np.uint32(32 - s)
            v &= np.uint32((1 << w) - 1)
            off[part] = v.T
    if exceptions.any():
        row = np.repeat(np.arange(len(at)), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = at[row] + HEAD + block // 32 * width[row]
        off[row, body.view(np.uint8)[4 * base + nth]] = body[base + (exceptions[row] + 3) // 4 + nth]
    return off + low[:, None]


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard and the length of each of its documents."""
    block, n, lengths, start, body = _sections(data)
    if not n:
        return np.zeros(0, "<u4"), lengths
    return _unpack(body, start, block).reshape(-1)[:n].astype("<u4", copy=False), lengths


def read_range(data: bytes, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive); only the blocks that hold them are unpacked."""
    block, n, _, start, body = _sections(data)
    first, last = max(0, first), min(n, last)
    if first >= last:
        return np.zeros(0, "<u4")
    a, b = first // block, -(-last // block)
    return _unpack(body, start[a:b], block).reshape(-1)[first - a * block : last - a * block]
