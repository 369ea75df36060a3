"""Line dedup: range-partitioned line hashes, streamed in order, returned as per-document keep bitmaps.

Each document gives a row for each of its distinct keys (a 128-bit hash, its doc_id, the positions of
the lines).  Rows are range-partitioned by (hash, doc_id descending) with the same secondary sort, so
that a hot line spans many tasks.  A task streams its sorted rows: the first document of a key keeps its
lines, the later ones lose them once the key has enough documents.  A key that touches the border of a
batch is left open: its rows and a count per batch go on, and a join on the key settles them.  The
result is a zlib-compressed bitmap per document that lost a line; texts are never shuffled for the
decision and meet the bitmaps only to be rewritten.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document for
counting, and each row keeps its own bitmap; a null doc_id counts as the smallest; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm.common import partitions_for, sliced, stage, table

MIN_CHARS = 40
MIN_DOCS = 5
ROWS_PER_TASK = 1_000_000
SALTS = 64
_SPACE = " \t\n\x0b\x0c\r"
_LOW = np.iinfo(np.int64).min  # stands for a null doc_id in the order


def _tagged(docs: DataFrame) -> DataFrame:
    """A row's identity is its doc_id and a hash of its text: repeated rows share both, and one bitmap."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tag"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``hi, lo, doc, tag, n_lines, at``: a row for each document and distinct key of at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches, 1):
            keys, doc, tag, n_lines, at = [], [], [], [], []
            for d, text, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found: dict[bytes, list[int]] = {}
                lines = (text or "").split("\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line.strip(_SPACE)) >= min_chars:
                        found.setdefault(xxh3_128_digest(key.encode().lower()), []).append(i)
                keys.extend(found)
                doc.extend([_LOW if d is None else d] * len(found))
                tag.extend([t] * len(found))
                n_lines.extend([len(lines)] * len(found))
                at.extend(np.array(x, "<u4").tobytes() for x in found.values())
            words = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(n_lines, pa.int32()), pa.array(at, pa.binary())],
                ["hi", "lo", "doc", "tag", "n_lines", "at"],
            )

    return _tagged(docs).mapInArrow(run, "hi long, lo long, doc long, tag long, n_lines int, at binary")


def _stream(min_docs: int):
    """Over rows sorted by (hi, lo, doc descending): kind 0, a row that loses its lines; 1, a row of an open key; 2, an open key's count in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # key and document of the row before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, doc = (batch.column(k).to_numpy() for k in range(3))
            new_key = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
            if before == (hi[0], lo[0], doc[0]):
                new_doc[0] = False  # counted with the batch before
            before = (hi[-1], lo[-1], doc[-1])
            start = np.flatnonzero(new_key)
            run_of = np.cumsum(new_key) - 1
            n_docs = np.add.reduceat(new_doc.astype(np.int64), start)
            is_open = np.zeros(len(start), bool)
            is_open[[0, -1]] = True
            loses = ~is_open[run_of] & (n_docs[run_of] >= min_docs) & (doc != doc[start][run_of])
            rows = np.flatnonzero(loses | is_open[run_of])
            kept = batch.take(pa.array(rows))
            kind = pa.array(is_open[run_of[rows]].astype(np.int32))
            none = pa.nulls(len(rows), pa.int64())
            names = ["kind", "hi", "lo", "doc", "tag", "n_lines", "at", "n_docs"]
            yield pa.RecordBatch.from_arrays([kind, *kept.columns, none], names)
            ends = start[is_open]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), 2, np.int32)), pa.array(hi[ends]), pa.array(lo[ends]), pa.array(doc[ends]), pa.nulls(len(ends), pa.int64()),
                 pa.nulls(len(ends), pa.int32()), pa.nulls(len(ends), pa.binary()), pa.array(n_docs[is_open])], names)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, tag, keep`` of the documents that lose a line; bit i of the decompressed bitmap, lowest first, is line i."""
    spark = docs.sparkSession
    keys = stage(line_keys(docs, min_chars), "op7-keys")
    order = ["hi", "lo", F.col("doc").desc()]
    seen = stage(
        keys.repartitionByRange(partitions_for(spark, keys.count(), ROWS_PER_TASK), *order).sortWithinPartitions(*order, "tag")
        .mapInArrow(_stream(min_docs), "kind int, hi long, lo long, doc long, tag long, n_lines int, at binary, n_docs long"),
        "op7-stream",
    )
    counts = seen.filter("kind = 2").groupBy("hi", "lo").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("last")).filter(F.col("docs") >= min_docs)
    # two keys of a batch at most are open, but a hot key's rows may fill many batches: they are dealt to salts, the counts copied
    salted = seen.filter("kind = 1").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    copied = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    settled = salted.join(copied, ["hi", "lo", "salt"]).filter("doc != last")
    lost = seen.filter("kind = 0").select("doc", "tag", "n_lines", "at").unionByName(settled.select("doc", "tag", "n_lines", "at"))
    # a document's own lines bound what its group holds
    per_doc = lost.groupBy("doc", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))

    def run(batches):
        for batch in batches:
            out = []
            for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, bool)
                keep[np.frombuffer(b"".join(at), "<u4")] = False
                out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc", "tag", "keep"])

    return per_doc.mapInArrow(run, "doc long, tag long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, list[str]]:
    """The number of lines, and those that stay."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return len(lines), [x for x, b in zip(lines, bits.tolist()) if b]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, text``, ``row`` (the other columns) and ``keep`` (null: nothing is dropped) of all of ``docs``."""
    own = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    return own.join(bitmaps.hint("merge"), ["doc", "tag"], "left").drop("doc", "tag")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with each text rewritten without the lines that go; null texts stay null."""

    @F.pandas_udf("string")
    def rewritten(text, keep):
        return text.combine(keep, lambda t, k: t if t is None or k is None else "\n".join(kept_lines(t, k)[1]))

    joined = with_bitmaps(docs, stage(keep_bitmaps(docs), "op7-keep"))
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(rewritten("text", "keep"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        for batch in sliced(batches, 1):
            n, lost, sha = [], [], []
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                all_lines, kept = kept_lines(text, keep)
                n.append(all_lines)
                lost.append(all_lines - len(kept))
                sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = with_bitmaps(docs, stage(keep_bitmaps(docs), "op7-keep"))
    return joined.select(F.col("doc_id").cast("long"), "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, h.k IS NOT NULL AND doc_id <> h.last AS gone
  FROM keyed LEFT JOIN hot h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
