"""The corpus pipeline: quality rules, line dedup, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``, with texts
rewritten where the stage says so and ``n_chars`` their length.  ``run`` writes every stage's result and
reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm import op2_packing, op3_quality, op6_simhash, op7_line_dedup, op8_suffix_dedup
from kvasir.llm.common import ready, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone, ``n_chars`` following the text."""
    kind = dict(like.dtypes).get("n_chars", "bigint")
    return df.withColumn("n_chars", F.length("text").cast(kind)).select(*[c for c in COLUMNS if c in df.columns or c == "n_chars"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ready(spark)
    return op3_quality.judge(docs).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that five or more documents share, but in the last of them."""
    ready(spark)
    return _as_documents(op7_line_dedup.dedup_lines(docs.select(*COLUMNS)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ready(spark)
    return op6_simhash.keep_one(docs.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 200-byte strings that occur elsewhere too; a document without any byte left goes."""
    ready(spark)
    left = op8_suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    return _as_documents(left.filter("text IS NULL OR text != ''"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    import public_tokenizers

    ready(spark)
    return op2_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
