"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes."""

from __future__ import annotations

import numpy as np

_LOW = np.int64((1 << 32) - 1)


def build(flat: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform, the prefix lengths (up to ``cap``) that neighbours share, and the last-to-first order.

    ``flat`` holds the texts' symbols, integers from 1, one text after the other, ``sizes`` the lengths.
    Round j inserts the j-th symbol from the end of every text that has one.  The first ``len(sizes)``
    places are the texts' empty suffixes, in order.  A place's symbol is the one before its suffix; 0
    marks a text's start.  Each round goes once through the arrays in order: the places of a symbol, in
    order, are the places of the longer suffixes (last-to-first), and a new suffix shares with its
    neighbours one symbol more than the least shared between the places that they come from.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    symbols, shared = np.zeros(n, np.int32), np.zeros(n + 1, np.uint8)  # shared[i]: of places i - 1 and i
    keys = np.zeros(0, np.int64)  # (symbol, place) of the places that hold a symbol, sorted
    who, at = np.arange(n), np.arange(n)  # the texts that still grow, and the place of each one's longest suffix
    for j in range(1, int(sizes.max(initial=0)) + 1):
        grow = sizes[who] >= j
        who, at = who[grow], at[grow]
        symbol = flat[ends[who] - j].astype(np.int64)
        symbols[at] = symbol
        by = np.argsort(symbol, kind="stable")  # by symbol, then by place, as the places ascend
        who, at, symbol = who[by], at[by], symbol[by]
        own = symbol << 32 | at
        rank = np.searchsorted(keys, own) + np.arange(len(own))
        keys = _insert(keys, rank, own)
        before, after = keys[rank - 1], keys[np.minimum(rank + 1, len(keys) - 1)]
        has_before, has_after = (rank > 0) & (before >> 32 == symbol), (rank + 1 < len(keys)) & (after >> 32 == symbol)
        left = _least(shared, before & _LOW, at, has_before, by)
        right = _least(shared, at, after & _LOW, has_after, by)
        new = n + rank
        old = np.ones(len(symbols) + len(new), bool)
        old[new] = False
        grown = np.zeros(len(old), np.int32)
        grown[old] = symbols
        wider = np.zeros(len(old) + 1, np.uint8)
        wider[:-1][old] = shared[:-1]
        wider[new] = np.where(has_before, np.minimum(left.astype(np.int64) + 1, cap), 0)
        wider[new + 1] = np.where(has_after, np.minimum(right.astype(np.int64) + 1, cap), 0)
        place = keys & _LOW
        keys += np.take(np.flatnonzero(old), place) - place
        symbols, shared, at = grown, wider, new
    return symbols, shared, keys & _LOW


def _insert(into: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``into`` with ``values`` at the final ``places``, which ascend."""
    out = np.empty(len(into) + len(values), into.dtype)
    old = np.ones(len(out), bool)
    old[places] = False
    out[places] = values
    out[old] = into
    return out


def _least(shared: np.ndarray, a: np.ndarray, b: np.ndarray, ok: np.ndarray, by: np.ndarray) -> np.ndarray:
    """min(shared[a + 1 : b + 1]) where ``ok``; ``by`` tells each range's turn in order of place, so that one pass serves all."""
    turn = np.empty(len(by), np.int64)
    turn[by] = np.arange(len(by))  # the range that comes k-th in order of place
    turn = turn[ok[turn]]
    out = np.zeros(len(a), np.uint8)
    if len(turn):
        pairs = np.empty(2 * len(turn), np.int64)
        pairs[::2], pairs[1::2] = a[turn] + 1, b[turn] + 1
        out[turn] = np.minimum.reduceat(shared, np.minimum(pairs, len(shared) - 1))[::2]
    return out


def _marked(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the ``width``-symbol strings that also start elsewhere in the collection."""
    symbols, shared, order = build(flat, sizes, width)
    n = len(sizes)
    to = np.empty(len(symbols), np.int64)
    to[order] = n + np.arange(len(order))
    twice = (shared[:-1] >= width) | (shared[1:] >= width)
    who, at, texts, starts = np.arange(n), np.arange(n), [], []
    for j in range(1, int(sizes.max(initial=0)) + 1):  # from each empty suffix back to the text's start
        grow = sizes[who] >= j
        who, at = who[grow], to[at[grow]]
        if j >= width:
            hit = who[twice[at]]
            texts.append(hit)
            starts.append(sizes[hit] - j)
    return (np.concatenate(texts), np.concatenate(starts)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def repeated_starts(texts: list[bytes], width: int, places: list[int] | None = None) -> list[np.ndarray]:
    """For each text the starts of its ``width``-byte strings that also start elsewhere in the collection.

    With ``places``, equal strings are known to lie alike towards their texts' places.  Then a symbol is a
    word of up to eight bytes that divides the width, and the collection is built once for each distance
    to the place modulo the word: fewer rounds over shorter arrays, the same result.
    """
    word = next(k for k in (8, 4, 2, 1) if width % k == 0) if places is not None else 1
    owners, found = [], []
    for phase in range(word):
        first = [(phase + p) % word for p in places] if places is not None else [0] * len(texts)
        sizes = np.array([max(0, len(t) - f) // word for t, f in zip(texts, first)], np.int64)
        raw = b"".join(t[f : f + int(m) * word] for t, f, m in zip(texts, first, sizes))
        words = np.frombuffer(raw, {8: ">u8", 4: ">u4", 2: ">u2", 1: "u1"}[word])
        flat = words.astype(np.int64) + 1 if word < 4 else np.unique(words, return_inverse=True)[1] + 1
        who, start = _marked(flat, sizes, width // word)
        owners.append(who)
        found.append(start * word + np.array(first, np.int64)[who])
    who, start = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((start, who))
    return np.split(start[order], np.cumsum(np.bincount(who, minlength=len(texts)))[:-1])
