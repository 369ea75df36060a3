"""Encoding of whole texts with public tokenizers files, run by run through a bounded table."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from kvasir.llm.common import SparkSession

#: Slots of a worker's table of runs, ids that a slot holds, and the longest run kept: with 42 bytes a slot, 22 MB.
SLOTS = 1 << 19
WIDTH = 12
LONGEST = 64
#: Pieces of the slow path that are kept.
PIECES = 60_000
#: Characters that are cut into runs at once.
CHARS = 1 << 19

#: A space after a character that is no white space: both parts are split alike on their own.
_CUT = re.compile(r"(?<=\S) ")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_LETTER, _DIGIT, _MARK, _LINE, _SPACE, _END = 1, 2, 3, 4, 5, 6


def _classes() -> np.ndarray:
    """The class of each Latin-1 character whose class no Unicode version disputes; no apostrophes, and 0 for all others."""
    out = np.zeros(256, np.uint8)
    for kind, chars in ((_LETTER, _LETTERS), (_DIGIT, "0-9"), (_MARK, _MARKS), (_LINE, "\n"), (_SPACE, " "), (_END, "\0")):
        found = re.compile(f"[{chars}]")
        out[[c for c in range(256) if found.match(chr(c))]] = kind
    return out


_CLASS = _classes()
_LOWER = np.array([ord(chr(c).lower()) if _CLASS[c] == _LETTER else c for c in range(256)], np.uint8)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hash:
    """A mixed polynomial hash of any stretch of a buffer, 64 bits."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            self.up, self.down = _powers(len(raw), self.base), _powers(len(raw), pow(self.base, -1, 1 << 64))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], out=sums[1:], dtype=np.uint64)
        h = (sums[end] - sums[start]) * self.up[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def source(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast string: executors need no copy of it (a file's size bounds it)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Texts are cut into the runs that the file's pre-tokenizer always keeps apart.  ``kind`` "byte": a run
    takes the space before it.  ``kind`` "word": spaces and line ends are dropped, as the file does, and
    case is folded.  Runs are known by two 64-bit hashes in a table of ``SLOTS`` slots; one that is not
    there is made by the library's model and takes its slot, unless that was asked for since the last try.  A text that holds anything else than such
    runs is cut at spaces and its pieces go to the library's whole pipeline; one that could hold a
    special token is encoded whole.
    """

    def __init__(self, spec: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.kind = Tokenizer.from_str(spec), kind
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the letters that spell the bytes of each character that a run can hold
        self.letters = {int(c): level.pre_tokenize_str(chr(c))[0][0] for c in np.flatnonzero(_CLASS[1:]) + 1}
        self.first, self.second = _Hash(0x9E3779B97F4A7C15), _Hash(0xC2B2AE3D27D4EB4F)
        self.keys = np.zeros((SLOTS, 2), np.uint64)
        self.sizes, self.asked = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, bool)
        self.table = np.zeros((SLOTS, WIDTH), self.dtype)
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> list[int]:
        return [t.id for t in self.model.tokenize(run.translate(self.letters))]

    def _pieced(self, text: str) -> bytes:
        """A text that is not all runs."""
        if self.kind == "word":
            pieces = text.replace("\n", " ").split(" ")
        else:
            first, *rest = _CUT.split(text)
            pieces = [first, *(" " + p for p in rest)]
        out = []
        for piece in pieces:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self._whole(piece)
                if len(piece) <= LONGEST:
                    if len(self.pieces) >= PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _segments(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the buffer's runs, and the places that no run or dropped space explains."""
        kind = _CLASS[raw]
        change = kind[1:] != kind[:-1]
        if self.kind == "word":
            change |= kind[1:] == _DIGIT  # a digit is a run of its own
        start = np.concatenate([[0], np.flatnonzero(change) + 1])
        end = np.append(start[1:], len(raw))
        own, size = kind[start], end - start
        odd = (own == 0) | ((own <= _MARK) & (size > LONGEST - 1))
        if self.kind == "word":
            is_run = (own > 0) & (own <= _MARK)
        else:
            after = np.append(own[1:], 0)
            odd |= ((own == _LINE) | (own == _SPACE)) & (size > 1)
            odd |= (own == _SPACE) & ((after == 0) | (after > _MARK))
            is_run = (own > 0) & (own <= _LINE)
            spaced = np.concatenate([[False], own[:-1] == _SPACE]) & (own <= _MARK)
            start = start - spaced
        return start[is_run], end[is_run], start[odd]

    def _ids(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each run (a row of the table's width), their number, and the runs that take more or share one hash of two."""
        h1, h2 = self.first.of(raw, start, end), self.second.of(raw, start, end)
        slot = (h1 >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        ids, sizes = self.table[slot], self.sizes[slot]
        hit = (self.keys[slot, 0] == h1) & (self.keys[slot, 1] == h2) & (sizes > 0)
        self.asked[slot[hit]] = True
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return ids, sizes, miss
        _, one, of = np.unique(h1[miss], return_index=True, return_inverse=True)
        text = raw.tobytes()
        made = [self._run(text[a:b].decode("latin-1")) for a, b in zip(start[miss[one]].tolist(), end[miss[one]].tolist())]
        n = np.fromiter(map(len, made), np.int64, len(made))
        rows = np.zeros((len(made), WIDTH), self.dtype)
        short = n <= WIDTH
        rows[np.arange(WIDTH) < np.where(short, n, 0)[:, None]] = np.fromiter((x for m in made if len(m) <= WIDTH for x in m), self.dtype)
        ids[miss], sizes[miss] = rows[of], np.where(short, n, 0)[of]
        over = ~short[of] | (h2[miss] != h2[miss[one]][of])
        into = slot[miss[one]]
        free = short & ~self.asked[into]
        self.asked[into] = False
        keep, into = miss[one][free], into[free]
        self.keys[into, 0], self.keys[into, 1] = h1[keep], h2[keep]
        self.sizes[into] = n[free]
        self.table[into] = rows[free]
        return ids, sizes, miss[over]

    def _encode(self, texts: list[str]) -> list[bytes]:
        raws: list[bytes] = []
        for text in texts:
            try:
                raws.append(text.encode("latin-1"))
            except UnicodeEncodeError:
                raws.append(b"")
        # a zero byte ends each text
        raw = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        if self.kind == "word":
            raw = _LOWER[raw]
        bounds = np.cumsum([0, *[len(r) + 1 for r in raws]])
        start, end, odd = self._segments(raw)
        slow = np.zeros(len(texts) + 1, bool)
        slow[np.searchsorted(bounds, odd, side="right") - 1] = True
        out: list[bytes] = [b""] * len(texts)
        if len(start):
            ids, sizes, over = self._ids(raw, start, end)
            slow[np.searchsorted(bounds, start[over], side="right") - 1] = True
            flat = ids[np.arange(WIDTH) < sizes[:, None]].tobytes()
            upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.searchsorted(start, bounds)] * self.dtype.itemsize
            out = [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for k, text in enumerate(texts):
            if any(s in text for s in self.specials):
                out[k] = self._whole(text)
            elif slow[k] or "\0" in text or len(raws[k]) != len(text):
                out[k] = self._pieced(text)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian ``dtype``; None counts as the empty text."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= CHARS:
                out.extend(self._encode(held))
                held, size = [], 0
        if held:
            out.extend(self._encode(held))
        return out


_ENCODERS: dict[tuple[int, str], WordEncoder] = {}


def encoder(spec: str, kind: str) -> WordEncoder:
    """This worker's encoder; its table outlives a task."""
    key = (hash(spec), kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec, kind)
    return _ENCODERS[key]
