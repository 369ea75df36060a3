"""Token-ID output: canonical length-limited Huffman blocks with bit-offset checkpoints.

File format (``FORMAT``).  A folder with two Parquet containers, so that Spark's own commit protocol
writes them on any file system and a lost executor's half-written output never counts:

* ``codebook``: one row, ``lengths`` (a byte per id: its code length, 0 if it never occurs).  Canonical
  codes follow from the lengths.
* ``blocks``: rows ``part``, ``block``, ``first`` (ids of earlier blocks of the part) and ``data``.  Parts
  ascend by doc_id.  ``data``, little-endian: magic ``KVTB``, version, number of ids, of documents and of
  checkpoints, checkpoint stride, bytes of the stream (six u32 after the magic); per document doc_id
  (i64), place in its part (u32), piece (u32), ids (u32), flags (u32, bit 0: doc_id is null); per
  checkpoint a u32 bit offset; the stream.  A block decodes alone.

Defined results: a null text is empty (only the end id); a null doc_id sorts first and is kept; rows
that repeat a doc_id are each written, ordered by their ids; other columns are ignored; an empty table
gives an empty folder that reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.llm import huffman, tokens
from kvasir.llm.common import drop, partitions_for, scratch, sliced, stage, table

FORMAT = b"KVTB"
BLOCK_IDS = 1 << 18
STRIDE = 128
PART_IDS = 6 << 20
#: File parts whose sizes one task adds up.
LOT = 4096
_DOC = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("piece", "<u4"), ("n", "<u4"), ("flags", "<u4")])


def tokenize(docs: DataFrame, tokenizer_path: str, kind: str = "byte", end_id: int | None = 0) -> DataFrame:
    """``doc_id, n_tokens, ids`` (ids little-endian, two bytes each if the vocabulary allows, else four)."""
    spec = tokens.source(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(spec.value, kind)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for part in sliced(batches, 1):
            ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
            n = np.fromiter((len(x) // enc.dtype.itemsize for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokenized: DataFrame, id_bytes: int) -> np.ndarray:
    """Global counts by id: each task sums its own, Spark the tasks'; at most a row for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in sliced(batches, 0):
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{id_bytes}")
            if len(ids):
                c = np.bincount(ids)
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    got = tokenized.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(got.id.max()) + 1 if len(got) else 0, np.int64)
    counts[got.id.to_numpy()] = got.n.to_numpy()
    return counts


def _pack_block(docs: list[tuple], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    stream, marks = huffman.encode(ids, codes, lengths, STRIDE)
    head = FORMAT + struct.pack("<6I", 1, len(ids), len(docs), len(marks), STRIDE, len(stream))
    return head + np.array(docs, _DOC).tobytes() + marks.astype("<u4").tobytes() + stream


def read_block(data: bytes, decoder: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The document table and all ids of one block."""
    if data[:4] != FORMAT:
        raise ValueError("not a token block")
    _, n, n_docs, n_marks, stride, size = struct.unpack_from("<6I", data, 4)
    at = 28 + n_docs * _DOC.itemsize
    docs, marks = np.frombuffer(data, _DOC, n_docs, 28), np.frombuffer(data, "<u4", n_marks, at)
    return docs, huffman.decode(data[at + 4 * n_marks :][:size], marks, n, stride, decoder)


def write(tokenized: DataFrame, out: str, id_bytes: int) -> None:
    """Write staged ``doc_id, n_tokens, ids`` rows as a folder of the format, in ascending doc_id order."""
    spark = tokenized.sparkSession
    counts = id_counts(tokenized, id_bytes)
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{out}/codebook")
    book = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens = book.value
        codes, part = huffman.canonical(lens), TaskContext.get().partitionId()
        block = first = seq = n = 0
        docs: list[tuple] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal block, first, n, docs, held
            row = (part, block, first, _pack_block(docs, np.concatenate(held), codes, lens))
            block, first, n, docs, held = block + 1, first + n, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "block", "first", "data"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{id_bytes}")
                for piece, k in enumerate(range(0, max(1, len(ids)), BLOCK_IDS)):
                    own = ids[k : k + BLOCK_IDS]
                    if n and n + len(own) > BLOCK_IDS:
                        yield flush()
                    docs.append((doc_id or 0, seq, piece, len(own), int(doc_id is None)))
                    held.append(own)
                    n += len(own)
                seq += 1
        if docs:
            yield flush()

    n_parts = partitions_for(spark, int(counts.sum()), PART_IDS)
    (
        tokenized.select("doc_id", "ids").repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(run, "part int, block long, first long, data binary")
        .write.mode("overwrite").option("compression", "none").parquet(f"{out}/blocks")
    )


def read(spark: SparkSession, path: str, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Read a folder back.

    Without ``digest``: a row per block and document, ``part, seq, piece, doc_id, n, first, ids`` (ids
    little-endian u32).  With it ``value`` stands for ``ids``: the function's value of the document's ids there.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)
    book = spark.sparkContext.broadcast(lengths)

    def run(batches):
        decoder = huffman.decode_table(book.value)
        for batch in sliced(batches, 2):
            for part, first, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs, ids = read_block(data, decoder)
                end = np.cumsum(docs["n"].astype(np.int64))
                cuts = [ids[b - k : b] for b, k in zip(end.tolist(), docs["n"].tolist())]
                last = pa.array([x.astype("<u4").tobytes() for x in cuts], pa.binary()) if digest is None else pa.array([digest(x) for x in cuts], pa.int64())
                names = [pa.array(np.full(len(docs), part, np.int32)), *(pa.array(docs[c].astype(np.int64)) for c in ("seq", "piece")),
                         pa.array(docs["doc_id"], mask=docs["flags"] > 0), pa.array(docs["n"].astype(np.int64)), pa.array(first + end - docs["n"]), last]
                yield pa.RecordBatch.from_arrays(names, ["part", "seq", "piece", "doc_id", "n", "first", "value" if digest else "ids"])

    kind = "value long" if digest else "ids binary"
    return spark.read.parquet(f"{path}/blocks").select("part", "first", "data").mapInArrow(run, f"part int, seq long, piece long, doc_id long, n long, first long, {kind}")


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two strings' concatenation: the first's value moves on by the second's zero bytes, as powers of the shift by one bit."""
    if not second_bytes:
        return first
    shift = [0xEDB88320] + [1 << k for k in range(31)]
    bits = second_bytes * 8
    while bits:
        if bits & 1:
            first = _times(shift, first)
        shift = [_times(shift, row) for row in shift]
        bits >>= 1
    return first ^ second


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of a written folder."""
    parts = stage(read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes())), "op1-read")

    @F.pandas_udf("long")
    def joined(pieces: pd.Series) -> pd.Series:
        def one(rows):
            rows = sorted(rows, key=lambda r: r["piece"])
            crc = rows[0]["value"]
            for r in rows[1:]:
                crc = crc32_joined(crc, r["value"], 4 * r["n"])
            return crc

        return pieces.map(one)

    # ids before each file part: within lots of LOT parts, and before the lots, so that one task orders a row per lot
    sizes = parts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("lot", F.expr(f"part div {LOT}"))
    before = F.sum("n").over(W.partitionBy("lot").orderBy("part")) - F.col("n")
    lots = sizes.groupBy("lot").agg(F.sum("n").alias("n"))
    lots = lots.select("lot", (F.sum("n").over(W.orderBy("lot")) - F.col("n")).alias("lot_base"))
    base = sizes.withColumn("before", before).join(lots, "lot").select("part", (F.col("lot_base") + F.col("before")).alias("base"))
    docs = parts.groupBy("part", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("piece", "n", "value")).alias("pieces"),  # one for each 2^18 ids of the document
    )
    one = docs.select("part", "doc_id", "first", "n_tokens", F.when(F.size("pieces") == 1, F.col("pieces")[0]["value"]).otherwise(joined("pieces")).alias("ids_crc32"))
    return one.join(base, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, out: str, kind: str = "byte", end_id: int = 0) -> None:
    """Tokenise whole texts once and write them in the format."""
    spark = docs.sparkSession
    held = scratch(spark, "op1-ids")
    raw = tokenize(docs, tokenizer_path, kind, end_id)
    raw.write.option("compression", "zstd").parquet(held)
    staged = spark.read.schema(raw.schema).parquet(held)
    with open(tokenizer_path, encoding="utf-8") as f:
        width = tokens.WordEncoder(f.read(), kind).dtype.itemsize
    write(staged, out, width)
    drop(spark, held)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "op1-files")
    encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return documents_of(spark, out)


QUERIES = {"op1_token_output": op1_token_output}
SQL: dict[str, str] = {}
