"""Patched frame-of-reference blocks for token ids.

Layout of a payload (all little-endian): magic ``FOR1``, uint32 number of ids, uint32 number of
blocks, uint32 block size; then per block uint32 minimum, uint8 bit width, uint16 number of
exceptions; then per block uint64 start of its packed words (the index of block starts, in bytes
from the first); then the packed words; then the exceptions of all blocks, uint16 place in the
block and uint32 value minus minimum. A block's ids minus its minimum are packed at the width that
holds the chosen percentile of them; wider ones are exceptions, whose low bits are packed as well.
The last block is filled up with its own minimum.

Words are laid out lane by lane: the i-th ids of all blocks of one width are packed together, so
that packing and unpacking are a few vector operations for each place in the block.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
MAGIC = b"FOR1"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of non-negative numbers below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width to (blocks, BLOCK * width / 32) words."""
    lanes = np.ascontiguousarray(values.T, np.uint32)
    out = np.zeros((BLOCK * width // 32, values.shape[0]), np.uint32)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 32)
        out[word] |= lanes[i] << np.uint32(shift)  # what does not fit falls off the top
        if shift + width > 32:
            out[word + 1] |= lanes[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T).astype("<u4", copy=False)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T).astype(np.uint64)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, words.shape[0]), np.uint32)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 32)
        part = lanes[word] >> np.uint64(shift)
        if shift + width > 32:
            part |= lanes[word + 1] << np.uint64(32 - shift)
        out[i] = part & mask
    return np.ascontiguousarray(out.T)


def encode(ids: np.ndarray, percentile: float = 95.0) -> bytes:
    """``ids``: unsigned 32-bit."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, blocks, BLOCK], "<u4").tobytes()
    if not n:
        return head
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK :].min()
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    k = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = _bits(np.partition(rest, k, axis=1)[:, k])
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    over = rest >= limit
    exceptions = over.sum(axis=1).astype("<u2")
    size = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype("<u8")
    words = np.zeros(int(size.sum()) // 4, "<u4")
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        place = (starts[at] // 4).astype(np.int64)[:, None] + np.arange(BLOCK * w // 32)
        words[place] = _pack(rest[at] & np.uint32((1 << w) - 1), w)
    where = np.nonzero(over)
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), exceptions.tobytes(), starts.tobytes(), words.tobytes(), where[1].astype("<u2").tobytes(), rest[where].astype("<u4").tobytes()])


def decode(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a FOR1 payload")
    n, blocks, size = np.frombuffer(payload, "<u4", 3, 4).tolist()
    if size != BLOCK:
        raise ValueError(f"block size {size}")
    at = 16
    parts = []
    for kind, item in (("<u4", 4), ("u1", 1), ("<u2", 2), ("<u8", 8)):
        parts.append(np.frombuffer(payload, kind, blocks, at))
        at += item * blocks
    low, width, exceptions, starts = parts
    n_words = int(width.astype(np.int64).sum()) * (BLOCK // 32)
    words = np.frombuffer(payload, "<u4", n_words, at)
    at += 4 * n_words
    total = int(exceptions.astype(np.int64).sum())
    places = np.frombuffer(payload, "<u2", total, at)
    values = np.frombuffer(payload, "<u4", total, at + 2 * total)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        place = (starts[of] // 4).astype(np.int64)[:, None] + np.arange(BLOCK * w // 32)
        out[of] = _unpack(words[place], w)
    out[np.repeat(np.arange(blocks), exceptions), places] = values
    out += low[:, None]
    return out.reshape(-1)[:n]
