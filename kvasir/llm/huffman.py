"""Canonical length-limited Huffman codes and bit packing on numpy arrays."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("limit too small for this many symbols")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)
    # levels[i] holds, in order of weight, whether an item of that level is a single symbol
    levels, packed = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([single, packed])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(single))
        merged = merged[by_weight]
        even = len(merged) // 2 * 2
        packed = merged[:even:2] + merged[1:even:2]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_single in reversed(levels):
        n = int(is_single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each the predecessor plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        l = lengths[order].astype(np.int64)
        width = int(l.max())
        span = np.int64(1) << (width - l)
        first = np.concatenate([[0], np.cumsum(span)[:-1]])
        codes[order] = (first >> (width - l)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of ``width`` bits the symbol that its first bits spell and the bits that it takes."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return np.zeros(2, np.uint32), np.ones(2, np.uint8), 1
    width = int(lengths.max())
    span = 1 << (width - lengths[order].astype(np.int64))
    symbols, bits = np.repeat(order, span), np.repeat(lengths[order], span)
    rest = (1 << width) - len(symbols)  # only a lone symbol leaves windows that no code spells
    return (np.concatenate([symbols, np.repeat(order[-1:], rest)]).astype(np.uint32),
            np.concatenate([bits, np.repeat(lengths[order[-1:]], rest)]).astype(np.uint8), width)


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int) -> tuple[bytes, np.ndarray]:
    """The bit stream, highest bit first, and the bit offset of every ``stride``-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    marks = at[::stride].astype(np.uint32)
    if not len(ids):
        return b"", marks
    slot = at >> 5
    wide = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    where = slot[starts]
    out[where] += np.add.reduceat(wide >> np.uint64(32), starts)
    out[where + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), starts)
    return out.astype(">u4").tobytes()[: -(-int(end[-1]) // 8)], marks


def decode(stream: bytes, marks: np.ndarray, n: int, stride: int, table: tuple) -> np.ndarray:
    """All ids of a block: the runs between checkpoints advance together, one table look-up each a step."""
    symbols, bits, width = table
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((stride, len(marks)), np.uint32)
    at = marks.astype(np.int64)
    last = len(window) - 1
    for k in range(min(stride, n)):
        w = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k] = symbols[w]
        at += bits[w]
    return out.T.reshape(-1)[:n]
