"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds ``BLOCK`` values: the block minimum is subtracted, the rest is
packed at the width that ``SHARE`` of the block's values need, and values that
need more are patched from the block's exception list.

    block := minimum u32 | width u8 | 0 u8 | exceptions u16 |
             BLOCK * width bits, little-endian | position u8 each | value u32 each

The last block is filled up with its own minimum.  ``pack`` also returns the
start of every block, for the index.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
SHARE = 0.9
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("patched", "<u2")])


def _bits(v: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _squeeze(v: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values of ``width`` bits -> (blocks, 32 * width) bytes."""
    lanes = v.reshape(len(v), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(v), BLOCK // 64, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return out.astype("<u8").view(np.uint8).reshape(len(v), 32 * width)


def _stretch(raw: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``_squeeze``."""
    words = np.ascontiguousarray(raw).view("<u8").reshape(len(raw), BLOCK // 64, width)
    out = np.empty((len(raw), BLOCK // 64, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, j] = v & mask
    return out.reshape(len(raw), BLOCK)


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(blocks as bytes, start of each block)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.empty(0, np.uint32)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = values
    v[n:] = values[(blocks - 1) * BLOCK:].min()
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    bits = _bits(v)
    width = np.sort(bits, axis=1)[:, int(np.ceil(SHARE * BLOCK)) - 1]
    out_of = bits > width[:, None]
    patched = out_of.sum(axis=1)
    start = np.concatenate([[0], np.cumsum(HEAD.itemsize + 32 * width + 5 * patched)])
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros(blocks, HEAD)
    head["low"], head["width"], head["patched"] = low, width, patched
    out[start[:-1, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, HEAD.itemsize)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        body = _squeeze(np.where(out_of[at], 0, v[at]), w)
        out[(start[at] + HEAD.itemsize)[:, None] + np.arange(32 * w)] = body
    block, pos = np.nonzero(out_of)
    if len(block):
        body = start[block] + HEAD.itemsize + 32 * width[block]
        rank = np.arange(len(block)) - np.repeat(np.cumsum(patched) - patched, patched)
        out[body + rank] = pos
        at = body + patched[block] + 4 * rank
        out[at[:, None] + np.arange(4)] = v[block, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start[:-1].astype(np.uint32)


def unpack(raw: bytes, start: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of the blocks that begin at ``start``."""
    if not len(start):
        return np.empty(0, np.uint32)
    data, start = np.frombuffer(raw, np.uint8), start.astype(np.int64)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).ravel()
    width, patched = head["width"].astype(np.int64), head["patched"].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        out[at] = _stretch(data[(start[at] + HEAD.itemsize)[:, None] + np.arange(32 * w)], w)
    block = np.repeat(np.arange(len(start)), patched)
    if len(block):
        body = start[block] + HEAD.itemsize + 32 * width[block]
        rank = np.arange(len(block)) - np.repeat(np.cumsum(patched) - patched, patched)
        at = body + patched[block] + 4 * rank
        out[block, data[body + rank]] = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    out += head["low"][:, None]
    return out.ravel()[:n]
