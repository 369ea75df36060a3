"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

The base statistics are expressions over the text's word and line arrays, needed of every row.  A rule is
a condition that rejects; the cheap ones compare statistics, the others scan the text, its lines or its
words.  On a bounded sample (``SAMPLE`` rows) each rule's cost and rejections are measured: the time of the
rule over ``REPEAT`` copies of the sample, less that of a rule that is false, and the rows that it rejects.
The rules become one CASE, greedily: next comes the rule that rejects most per cost of the rows that the
base and the rules before leave.  A branch is computed only if no earlier one rejects.  The order
changes the work and the rule named, never the verdict.

Defined results: a null text has no words and fails the base; an empty table gives no rows; repeated
rows keep a row each; a null doc_id is kept; a text of any length is judged whole; other columns are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm.common import table

SAMPLE = 1000
REPEAT = 8
RUNS = 2
MIN_WORDS = 50

#: Words run between these six characters.
_WORDS = r"array_remove(split(translate(t, '\t\n\u000b\u000c\r', '     '), ' '), '')"
_LINES = r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"

#: Words in 3-word windows that the text holds twice or more.  Hashes of the windows tell whether any can repeat;
#: if so, windows are sorted with their places, equal neighbours found, and places covered counted.
_REPEATED = """
CASE WHEN size(w) < 4 THEN 0L
  WHEN size(array_distinct(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))) = size(w) - 2 THEN 0L
  ELSE
    transform(array(array_sort(transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS x, i AS i)))), s ->
      size(array_distinct(flatten(transform(
        filter(s, (y, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = y.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = y.x)),
        y -> array(y.i, y.i + 1, y.i + 2)))))
    )[0] END
"""

#: Conditions that reject a text, by name, over the statistics, the text ``t``, its words ``w`` and its lines ``l``.
#: Thresholds are shares of words, lines or letters, as integers.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "repeats": "5 * n_repeat_words > 2 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '')) < length(regexp_replace(t, '[a-zß-öø-ÿ]', ''))",
    "exclaims": "10 * ((length(t) - length(replace(t, '!!', ''))) div 2) > n_words",
    "bullets": r"10 * size(filter(l, x -> x rlike '^[ \t]*[-*\u2022]')) > 9 * n_lines",
    "ellipses": r"10 * size(filter(l, x -> x rlike '([.][.][.]|\u2026)[ \t\r]*$')) > 3 * n_lines",
    "few_words": "size(array_distinct(w)) < 10",
    "letterless": r"5 * size(filter(w, x -> x rlike '\\p{L}')) < 4 * n_words",
}
BASE = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a one-row generator, which no filter or projection is merged into."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics, and ``t``, the text with null as empty, ``w`` and ``l``; a column of ``docs`` with one of these names gives way."""
    docs = docs.drop("t", "w", "l", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    arrays = _bound(docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit(""))), w=F.expr(_WORDS), l=F.expr(_LINES))
    return _bound(
        arrays,
        n_words=F.size("w").cast("long"),
        word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_symbols=(F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long"),
        n_lines=F.size("l").cast("long"),
        n_dup_lines=(F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        n_repeat_words=F.expr(_REPEATED).cast("long"),
    )


def measured(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE) -> tuple[dict[str, float], list[frozenset[str]]]:
    """Each rule's seconds a row, and the rules that reject each row of a sample of at most ``rows`` rows that pass the base."""
    n = docs.count()
    if not n:
        return dict.fromkeys(rules, 0.0), []
    some = docs.select("text").sample(min(1.0, 2 * rows / n), seed=7).limit(rows)
    sample = statistics(some).filter(f"NOT ({BASE})").repartition(docs.sparkSession.sparkContext.defaultParallelism).cache()
    try:
        held = max(sample.count(), 1)
        copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

        def seconds(rule: str) -> float:
            took = []
            for _ in range(RUNS):  # the first run compiles
                began = time.perf_counter()
                copies.agg(F.count_if(F.expr(f"({rule}) AND copy > 0"))).first()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds("false OR copy < 0")
        costs = {name: max(seconds(rule) - idle, 1e-4 * idle) / (held * REPEAT) for name, rule in rules.items()}
        found = sample.select(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()])).alias("by")).collect()  # SAMPLE rows at most
        return costs, [frozenset(r.by) for r in found]
    finally:
        sample.unpersist()


def greedy(costs: dict[str, float], rejects: list[frozenset[str]]) -> list[str]:
    """Rules by rejections per cost among the rows that the rules before leave; the cheaper first where none rejects, ties by name."""
    order, left, todo = [], rejects, sorted(costs)
    while todo:
        best = min(todo, key=lambda r: (-sum(r in x for x in left) / max(costs[r], 1e-12), costs[r], r))
        order.append(best)
        todo.remove(best)
        left = [x for x in left if best not in x]
    return order


def measured_order(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE) -> list[str]:
    return greedy(*measured(docs, rules, rows))


def cascade(rules: dict[str, str], order: list[str]) -> Column:
    """The first rule in ``order`` that rejects, or null."""
    return F.expr("CASE " + " ".join(f"WHEN {rules[r]} THEN '{r}'" for r in order) + " END")


def judge(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``failed_rule`` and ``kept``."""
    docs = docs.drop("base_failed", "failed_rule", "kept")
    order = measured_order(docs, rules)
    return (
        _bound(_bound(statistics(docs), base_failed=F.expr(BASE)), failed_rule=F.when(~F.expr(BASE), cascade(rules, order)))
        .withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("w", "l")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op3_quality": op3_quality}
SQL = {
    "op3_quality": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM places),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
stats AS (
  SELECT b.doc_id, t, w, l, len(w)::BIGINT AS n_words,
         coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR 5 * n_repeat_words > 2 * n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) < length(regexp_replace(t, '[a-zß-öø-ÿ]', '', 'g'))
         OR 10 * ((length(t) - length(replace(t, '!!', ''))) // 2) > n_words
         OR 10 * len([x FOR x IN l IF regexp_matches(x, '^[ \t]*[-*\x{2022}]')]) > 9 * n_lines
         OR 10 * len([x FOR x IN l IF regexp_matches(x, '([.][.][.]|\x{2026})[ \t\r]*$')]) > 3 * n_lines
         OR len(list_distinct(w)) < 10
         OR 5 * len([x FOR x IN w IF regexp_matches(x, '\p{L}')]) < 4 * n_words AS rejected
  FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
""",
}
