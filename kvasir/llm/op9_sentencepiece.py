"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

The model file is compiled to machines.  ``Normaliser`` is a transducer of two states: one arc from the
first writes the dummy prefix, and arcs of the second loop copy a character or write a space as U+2581.
The pieces are a trie whose final states emit an id at weight 1; byte fallback is an arc over a character
that no piece has, which emits its UTF-8 bytes' ids at weight 1 each.  The merge machine reads emitted
pieces: its state is the last one, and an arc has weight 0, or infinity if merging would not leave the
two as neighbours.  ``shortest`` composes them with an input: a state is a place and the last piece, and
relaxation in the tropical semiring (min, +) finds the least weight of each.  A sequence is what merging
leaves exactly if each of its neighbouring pairs is, so the paths of finite weight are the model's own
result.  The merge machine is needed as the file is a merge model; with plain scores as weights the
shortest path is a unigram segmentation, another result.

No piece has a U+2581 after another character (checked when compiling), so the lattice falls into chunks
that begin with U+2581 and are solved, and remembered, apart.  A slice's new chunks are solved in order,
so that one takes over the states of the beginning it shares with the one before it.

Defined results: a null or empty text has no ids; repeated rows keep a row each; a null doc_id is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm.common import sliced, table

SPACE = "▁"
CHUNKS = 300_000
PAIRS = 1_000_000
PREPARED = 4 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MERGES = 2
_NO = float("-inf")
_INFINITE = float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message."""

    def varint(at):
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class _Cache(dict):
    """Values by key, made when first asked for; a full cache starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CHUNKS:
            self.clear()
        self[key] = out = self.make(key)
        return out


class _Merges(dict):
    """The merge machine's arcs out of the state ``before``: weights by the next piece, made when first asked for."""

    def __init__(self, weigh, before: int):
        super().__init__()
        self.weigh, self.before = weigh, before

    def __missing__(self, piece):
        self[piece] = out = self.weigh(self.before, piece)
        return out


class Normaliser:
    """Arcs by (state, symbol) to (output, state); a symbol without an arc of its own is copied."""

    def __init__(self, prefix: bool):
        self.start = ("", 0) if not prefix else (SPACE, 1)
        self.arcs = {(state, " "): (SPACE, 1) for state in (0, 1)}

    def apply(self, text: str, begin: bool = True) -> str:
        """The output of the one path that reads the text; ``begin``: from the first state, with its arc that reads nothing."""
        first, state = self.start if begin else ("", 1)
        out = [first]
        for c in text:
            written, state = self.arcs.get((state, c), (c, 1))
            out.append(written)
        return "".join(out)


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        prefix, squeeze, charsmap, merges, fallback = True, True, b"", 1, False
        for field, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                k = len(self.pieces)
                self.pieces.append(piece)
                self.kinds.append(kind)
                if kind == _NORMAL:
                    self.ids[piece], self.scores[piece] = k, score
                elif kind == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = k
                elif kind == _UNKNOWN:
                    self.unknown = k
            elif field == 2:
                for f, v in _fields(value):
                    merges, fallback = (v if f == 3 else merges), (bool(v) if f == 35 else fallback)
            elif field == 3:
                for f, v in _fields(value):
                    charsmap = v if f == 2 else charsmap
                    prefix, squeeze = (bool(v) if f == 3 else prefix), (bool(v) if f == 4 else squeeze)
        if charsmap or squeeze or merges != _MERGES:
            raise ValueError("only merge models with the identity normaliser are compiled")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece spans words")
        self.prefix, self.fallback = prefix, fallback
        self.normaliser = Normaliser(prefix)
        # read from a piece's end; a node has its arcs by character: the next node, and the piece that begins there or -1
        self.trie: dict = {}
        for piece, k in self.ids.items():
            node = self.trie
            for c in piece[:0:-1]:
                node = node.setdefault(c, ({}, -1))[0]
            node[piece[0]] = (node.get(piece[0], ({}, -1))[0], k)
        self.longest = max(map(len, self.ids), default=0)
        self.splits_lines = not any("\n" in p for p in self.ids)
        self.merges: dict[int, _Merges] = {}
        self.pairs = 0
        self.written = [struct.pack("<I", k) for k in range(len(self.pieces))]
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts = _Cache(lambda part: next(self.shortest([part])))
        # ids of a chunk, and of the chunk that begins with a U+2581 and goes on like the key
        self.bare, self.spaced = _Cache(self._solved), _Cache(lambda chunk: self._solved(SPACE + chunk))
        # a byte below 128 is a character whatever stands beside it; None: the piece needs its neighbours or is none
        self.spelled: list[str | None] = [chr(int(p[3:5], 16)) if k == _BYTE and int(p[3:5], 16) < 128 else p if k == _NORMAL else None for p, k in zip(self.pieces, self.kinds)]
        self.plain = np.array([t is not None for t in self.spelled])

    def _merged(self, text: str) -> list[str]:
        """Merges the neighbours that make the piece of the best score, the first on ties, until none make one."""
        parts, score = list(text), self.scores.get
        worth = [score(x + y, _NO) for x, y in zip(parts, parts[1:])]
        while worth and (best := max(worth)) > _NO:
            i = worth.index(best)
            parts[i] += parts.pop(i + 1)
            del worth[i]
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], _NO)
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], _NO)
        return parts

    def joined_weight(self, before: int, piece: int) -> float:
        """The merge machine's arc from its state, the last piece (-1: bytes or none), over the next: infinite unless merging the two's characters leaves just these."""
        if before < 0 or piece < 0:
            return 0.0
        self.pairs += 1
        a, b = self.pieces[before], self.pieces[piece]
        return 0.0 if self._merged(a + b) == [a, b] else _INFINITE

    def shortest(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids on the shortest path through each normalised chunk, composed with pieces, fallback and merges.

        The states of a place depend on the text before it alone, so where a chunk begins as the last one did they
        are not relaxed again: sorted chunks share most of them.
        """
        trie, longest, ids, written, out_of, weigh = self.trie, self.longest, self.ids, self.written, self.merges, self.joined_weight
        # by place, the states that paths of finite weight reach: the least weight, the merge machine's arcs, the state before and what the arc from it emits
        last, best = "", [[(0.0, _Merges(weigh, -1), None, b"")]]
        for text in texts:
            if self.pairs >= PAIRS:
                out_of.clear()
                self.pairs = 0
            same = 0
            for x, y in zip(last, text):
                if x != y:
                    break
                same += 1
            del best[same + 1 :]
            last = text
            for end in range(same + 1, len(text) + 1):
                node, start, reached = trie, end, []
                for c in text[max(0, end - longest) : end][::-1]:
                    if (arc := node.get(c)) is None:
                        break
                    node, k = arc
                    start -= 1
                    if k >= 0:
                        least = _INFINITE
                        for state in best[start]:
                            if (total := state[0] + 1.0 + state[1][k]) < least:
                                least, before = total, state
                        if least < _INFINITE:
                            if (joined := out_of.get(k)) is None:
                                joined = out_of[k] = _Merges(weigh, k)
                            reached.append((least, joined, before, written[k]))
                if (c := text[end - 1]) not in ids and best[end - 1]:
                    before, spelled = min(best[end - 1], key=itemgetter(0)), c.encode()
                    emitted = b"".join(written[self.byte_ids[b]] for b in spelled) if self.fallback else written[self.unknown]
                    reached.append((before[0] + len(spelled), best[0][0][1], before, emitted))
                best.append(reached)
            if not best[-1]:
                raise ValueError(f"no path through {text!r}")
            out, state = [], min(best[-1], key=itemgetter(0))
            while state is not None:
                out.append(state[3])
                state = state[2]
            yield b"".join(out[::-1])

    def _solved(self, chunk: str) -> bytes:
        """Solved part by part: no piece spans two characters that stand together in no piece."""
        return b"".join(map(self.parts.__getitem__, self._cut(chunk)))

    def _cut(self, chunk: str) -> list[str]:
        if self.joined.issuperset(map(add, chunk, chunk[1:])):
            return [chunk]
        cuts = [0, *[k for k, pair in enumerate(map(add, chunk, chunk[1:]), 1) if pair not in self.joined], len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:])]

    def prepare(self, texts: list[str | None]) -> None:
        """Solves what is new of the texts' words in order; ``encode`` solves the others, and those of longer texts, as they come."""
        words: set[str] = set()
        for text in texts:
            if text and len(text) <= PREPARED:
                words.update(text.split(" "))
            if len(words) >= CHUNKS // 2:
                self._remember(words)
                words = set()
        self._remember(words)

    def _remember(self, words: set[str]) -> None:
        collects = gc.isenabled()
        gc.disable()  # no cycles arise, and the collector would visit all states and the caches again and again
        try:
            if len(self.spaced) + len(words - self.spaced.keys()) > CHUNKS:
                self.spaced.clear()
            cuts = {w: self._cut(SPACE + w) for w in words - self.spaced.keys() if "\n" not in w and SPACE not in w}
            found = {part for parts in cuts.values() for part in parts}
            if len(self.parts) + len(found - self.parts.keys()) > CHUNKS:
                self.parts.clear()
            new = sorted(found - self.parts.keys())
            self.parts.update(zip(new, self.shortest(new)))
            for w, parts in cuts.items():
                self.spaced[w] = self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))
        finally:
            if collects:
                gc.enable()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, as u32."""
        if not text:
            return np.zeros(0, "<u4")
        bare, spaced, out = self.bare.__getitem__, self.spaced.__getitem__, []
        for k, line in enumerate(text.split("\n") if self.splits_lines else [text]):
            lead = not k and self.prefix
            if k:
                out.append(bare("\n"))
            if "  " in line or line.endswith(" ") or SPACE in line or (lead and line.startswith(" ")):
                normal = self.normaliser.apply(line, lead)
                out.extend(map(bare, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)))
                continue
            words = line.split(" ")
            if not lead and (first := words.pop(0)):
                out.append(bare(first))
            out.extend(map(spaced, words))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse transducer's output.  A byte that begins no character becomes U+FFFD."""
        if self.plain[ids].all():
            return self._unescaped("".join(map(self.spelled.__getitem__, ids.tolist())))
        out, held = [], bytearray()

        def spell():
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for k in ids.tolist():
            kind = self.kinds[k]
            if kind == _BYTE:
                held.append(int(self.pieces[k][3:5], 16))
                continue
            spell()
            if kind == _UNKNOWN:
                out.append(" ⁇ ")
            elif kind != _CONTROL:
                out.append(self.pieces[k])
        spell()
        return self._unescaped("".join(out))

    def _unescaped(self, text: str) -> str:
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """This worker's transducer; its memory outlives a task."""
    key = zlib.crc32(model)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
        gc.freeze()  # the machines stay, and the collector need not visit them
    return _COMPILED[key]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text, ids`` (little-endian u32) of whole texts."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for part in sliced(batches, 1):
            texts = part.column(1).to_pylist()
            t.prepare(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.encode(x).tobytes() for x in texts], pa.binary())], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of encoded rows."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        t = compiled(model.value)
        for batch in sliced(batches, 1):
            texts = [t.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids encoded and decoded again, as counts and digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        is_byte = np.array([k == _BYTE for k in t.kinds])
        for batch in sliced(batches, 2):
            n, n_bytes, crc, back, sha = [], [], [], [], []
            for text, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                n_bytes.append(int(is_byte[ids].sum()))
                crc.append(zlib.crc32(raw))
                got = t.decode(ids)
                back.append(got == (text or ""))
                sha.append(hashlib.sha256(got.encode()).hexdigest())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((n, n_bytes, crc, back, sha), kinds))], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "decoded_sha256"])

    encoded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, decoded_sha256 string")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
