import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, tag long, spans__ string, shard int"


def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows, ties, copies, shared lines and passages."""
    rng = random.Random(11)
    words = ["the", "of", "and", "Tion", "er", "ingly", "heed", "ñandú", "été", "x1", "a,b", "日本", "it's", "(c)", "and***"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    line, passage, base = "A shared line of well over forty characters, yes", text(80), text(120)
    rows = [(1, None), (2, ""), (3, "   \n\t\n"), (4, "one"), (5, "two words"), (None, "no id " + text(30)), (None, None), (7, "\n"), (8, "Ünï\r\ncode x\x0b y\x00z")]
    rows += [(10 + i, text(12) + "\n" + ("  " * i + (line.upper() if i % 2 else line) + "\t") + "\n" + text(5)) for i in range(7)]
    rows += [(16, rows[-1][1])] + [(20 + i, base) for i in range(4)] + [(20, base)]
    rows += [(30 + i, text(20 + i) + " " + passage + " " + text(15)) for i in range(4)]
    rows += [(40, "ab" * 400), (41, text(6000)), (42, base.replace("of", "off", 1)), (43, passage[:250] + "\n" + passage[:250]), (44, "Er " * 300)]
    rows += [(50 + i, text(rng.randint(1, 90))) for i in range(30)]
    return [(d, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), None, "x", 1, None, 2) for d, t in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The rows, their DataFrame, and a folder with them as ``documents``."""
    from kvasir.functions.shipping import ship

    ship(spark)
    rows = odd_rows()
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows, spark.read.parquet(f"{folder}/documents.parquet"), folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
