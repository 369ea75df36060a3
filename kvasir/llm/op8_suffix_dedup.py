"""Exact removal of repeated byte strings by column-wise suffix sorting of document parts.

A column-wise construction takes as many rounds as its longest text has symbols, each over all that is
built so far; over whole documents of 100 KB that cannot end.  So documents are first cut into parts
that keep equal strings together: every ``WIDTH``-byte string belongs to the place of the least hash
among its ``ANCHOR``-byte substrings (its anchor, the leftmost on ties), and a run of strings with one
anchor is one part, at most ``2 * WIDTH - ANCHOR`` bytes long.  Equal strings have equal anchors, so:

1. parts whose anchor occurs once have no repeated string and go no further;
2. equal parts collapse to one with a count (all strings of a part that occurs twice repeat);
3. where an anchor has several distinct parts, their texts are fetched, dealt to shards by anchor, and
   each shard's collection gets its Burrows-Wheeler transform and common prefixes column by column
   (``bwt.build``); neighbours that share ``WIDTH`` bytes are repeated strings.  Equal strings lie alike
   towards their anchors, so a symbol there is a word of eight bytes, and the construction runs once
   for each distance to the anchor modulo eight.

The transform and the prefixes of a shard (a few MB) are arrays that each round reads and rewrites in
order, the role of the sequential files in external memory; no executor-local file is used.  An anchor
with over ``GROUP`` distinct parts is split: a string has at least half of its other bytes to the left
or to the right of its anchor, so parts that share a string share the bytes there, and each part joins
the two groups of those bytes.  A group that is still too large deals out its strings by hash instead.

Defined results: a null text is empty; rows that repeat a text are separate places, so all their
strings repeat; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm import bwt
from kvasir.llm.common import give_back, sliced, stage, table

WIDTH = 200
ANCHOR = 48
GROUP = 20_000
SHARD_BYTES = 1 << 20
CHUNK = 1 << 20
_SLOT = np.uint64(22)  # bits of a place within a chunk


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _anchor_hashes(raw: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of every ``size`` bytes."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=sums[1:], dtype=np.uint64)
    h = (sums[size:] - sums[:-size]) * up[: len(raw) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    span = 1
    while 2 * span <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if k > span else x


def parts_of(texts: list[bytes], width: int, anchor: int) -> list[np.ndarray]:
    """Per text the rows (start, strings, place of the anchor, anchor's hash) of its parts, for texts of at least ``width`` bytes in all."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _powers(len(raw) + 1, _BASE), _powers(len(raw) + 1, _INVERSE)
    h = _anchor_hashes(raw, anchor, up, down)
    slot = np.uint64((1 << 22) - 1)
    least = _sliding_least((h & ~slot) | np.arange(len(h), dtype=np.uint64), width - anchor + 1)
    place = (least & slot).astype(np.int64)
    out, base = [], 0
    for t in texts:
        n = len(t) - width + 1
        if n < 1:
            out.append(np.zeros((0, 4), np.int64))
        else:
            own = place[base : base + n]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.append(start, n))
            out.append(np.stack([start, size, own[start] - base, h[own[start]].view(np.int64)], 1))
        base += len(t)
    return out


def _chunks(rows: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about ``CHUNK`` bytes; a long text is cut so that no string is lost."""
    held, size = [], 0
    for k, raw in enumerate(rows):
        if len(raw) < width:
            continue
        for at in range(0, len(raw) - width + 1, CHUNK):
            own = raw[at : at + CHUNK + width - 1]
            held.append((k, at, own))
            size += len(own)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _located(docs: DataFrame) -> DataFrame:
    """``doc`` (never null), ``tag`` and ``text``: rows that repeat both are alike in all that follows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("doc_id", text).alias("tag"), text.alias("text"))


_PART = "anchor long, content long, doc long, tag long, start long, strings int, place int"


def document_parts(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in sliced(batches, 2):
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in _chunks([t.encode() for t in batch.column(2).to_pylist()], width):
                found = parts_of([raw for _, _, raw in chunk], width, anchor)
                rows = np.concatenate(found)
                which = np.repeat([k for k, _, _ in chunk], [len(f) for f in found])
                shift = np.repeat([at for _, at, _ in chunk], [len(f) for f in found])
                content = np.array([xxh3_64_intdigest(raw[s : s + n + width - 1]) for (_, _, raw), f in zip(chunk, found) for s, n in f[:, :2].tolist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rows[:, 3], content, doc[which], tag[which], rows[:, 0] + shift, rows[:, 1].astype(np.int32), (rows[:, 2] - rows[:, 0]).astype(np.int32))],
                    ["anchor", "content", "doc", "tag", "start", "strings", "place"])

    return _located(docs).mapInArrow(run, _PART)


def _fetch(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the ``wanted`` parts, a row for each: ``anchor, content, n, k, place, raw, doc, tag, start``."""
    per_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "content", "n", "k", "start", "strings", "place")).alias("parts"))
    # repeated rows are alike: one of them serves
    texts = _located(docs).join(per_doc.hint("merge"), ["doc", "tag"])

    def run(batches):
        for part in sliced(batches, 2):
            out = []
            for doc, tag, text, parts in zip(*(part.column(c).to_pylist() for c in range(4))):
                raw = text.encode()
                out.extend((p["anchor"], p["content"], p["n"], p["k"], p["place"], raw[p["start"] : p["start"] + p["strings"] + width - 1], doc, tag, p["start"]) for p in parts)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["anchor", "content", "n", "k", "place", "raw", "doc", "tag", "start"])

    return texts.select("doc", "tag", "text", "parts").mapInArrow(run, "anchor long, content long, n long, k long, place int, raw binary, doc long, tag long, start long").dropDuplicates(["anchor", "content"])


_SPAN = "doc long, tag long, start long, strings long"


def _shard_spans(width: int):
    """Each shard: the runs of repeated strings in its parts that occur once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "content"])  # a part that came with two groups is one text
        once = (pdf.n == 1).to_numpy()
        out = []
        for k, starts in enumerate(bwt.repeated_starts([bytes(x) for x in pdf.raw], width, pdf.place.tolist())):
            if once[k] and len(starts):
                first = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
                size = np.diff(np.append(first, len(starts)))
                out.extend((pdf.doc.iat[k], pdf.tag.iat[k], pdf.start.iat[k] + s, n) for s, n in zip(starts[first].tolist(), size.tolist()))
        give_back()
        return pd.DataFrame(out, columns=["doc", "tag", "start", "strings"])

    return run


def _sorted_spans(texts: DataFrame, width: int) -> DataFrame:
    """Spans of the groups ``grp`` of ``texts``, dealt to shards of about ``SHARD_BYTES``."""
    size = texts.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES), 2 * texts.sparkSession.sparkContext.defaultParallelism if size > SHARD_BYTES else 1)
    return texts.withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(n))).groupBy("shard").applyInPandas(_shard_spans(width), _SPAN)


def _dealt_spans(texts: DataFrame, width: int) -> DataFrame:
    """The same for groups beyond any shard: every string is a row of its two hashes, and the counts come back."""

    def strings(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for row in batch.select(["n", "raw", "doc", "tag", "start"]).to_pylist():
                raw, m = row["raw"], len(row["raw"]) - width + 1
                words = np.frombuffer(b"".join(xxh3_128_digest(raw[i : i + width]) for i in range(m)), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(np.full(m, row["n"])), pa.array(np.full(m, row["doc"])), pa.array(np.full(m, row["tag"])), pa.array(row["start"] + np.arange(m))],
                    ["h1", "h2", "n", "doc", "tag", "start"])

    rows = texts.mapInArrow(strings, "h1 long, h2 long, n long, doc long, tag long, start long")
    twice = rows.groupBy("h1", "h2").agg(F.sum("n").alias("all")).filter("all > 1").select("h1", "h2")
    return rows.filter("n = 1").join(twice, ["h1", "h2"], "left_semi").select("doc", "tag", "start", F.lit(1).cast("long").alias("strings"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """``doc, tag, start, strings``: runs of consecutive starts of repeated strings; some rows may overlap."""
    parts = stage(document_parts(docs, width, anchor), "op8-parts")
    # counted apart and written before they are joined: Spark then splits the rows of a hot anchor among tasks
    counted = stage(parts.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "start", "strings", "place")).alias("one")), "op8-counted")
    groups = stage(counted.groupBy("anchor").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("rows > 1"), "op8-groups")
    wanted = counted.join(groups.filter("k > 1 AND least = 1").select("anchor", "k"), "anchor").select("anchor", "content", "n", "k", "one.*")
    texts = stage(_fetch(docs, wanted, width), "op8-texts")
    spans = [parts.join(counted.filter("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("doc", "tag", "start", F.col("strings").cast("long"))]
    fits = F.col("k") <= group
    spans.append(_sorted_spans(texts.filter(fits).withColumn("grp", F.struct("anchor")), width))
    big = texts.filter(~fits)
    if not big.isEmpty():
        half = (width - anchor + 1) // 2
        place, size = F.col("place"), F.length("raw")
        sides = big.select("*", F.explode(F.array(
            F.when(place >= half, F.struct(F.lit(0).alias("side"), F.xxhash64(F.expr(f"substring(raw, place - {half} + 1, {half})")).alias("key"))),
            F.when(size >= place + anchor + half, F.struct(F.lit(1).alias("side"), F.xxhash64(F.expr(f"substring(raw, place + {anchor} + 1, {half})")).alias("key"))),
        )).alias("s")).filter("s IS NOT NULL").withColumn("grp", F.struct("anchor", "s.side", "s.key"))
        sizes = sides.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
        sides = stage(sides.drop("s").join(sizes, "grp"), "op8-sides")
        spans.append(_sorted_spans(sides.filter(F.col("members") <= group), width))
        # the strings of a part are dealt once, however many of its groups are too large
        spans.append(_dealt_spans(sides.filter(F.col("members") > group).dropDuplicates(["anchor", "content"]), width))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def cut(raw: bytes, spans: list | None, width: int = WIDTH) -> tuple[bytes, int]:
    """The bytes that no repeated string covers, and the number of runs removed."""
    kept, at, runs = [], 0, 0
    for s, n in sorted((x["start"], x["strings"]) for x in (() if spans is None else spans)):
        e = s + n + width - 1
        if not runs or s > at:
            kept.append(raw[at:s])
            runs += 1
        at = max(at, e)
    kept.append(raw[at:])
    return b"".join(kept), runs


def _with_spans(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """``doc_id, text``, ``row`` (the other columns) and ``spans`` (null: nothing repeats) of all of ``docs``."""
    spans = stage(repeated_spans(docs, width, anchor).groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "strings")).alias("spans")), "op8-spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("doc_id", text).alias("tag"))
    return own.join(spans.hint("merge"), ["doc", "tag"], "left").drop("doc", "tag")


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with each text rewritten without repeated strings; a character that loses a byte goes, null texts stay null."""

    @F.pandas_udf("string")
    def rewritten(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None else cut(t.encode(), s, width)[0].decode(errors="ignore"))

    joined = _with_spans(docs, width, anchor)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewritten("text", "spans"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        for part in sliced(batches, 1):
            out = []
            for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in range(3))):
                raw = (text or "").encode()
                kept, runs = cut(raw, spans)
                out.append((doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, WIDTH, ANCHOR).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
