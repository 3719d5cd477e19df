"""Small awkward tables."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside.
CLASH = "hash string, body string, size string, turn int, slice int, source_name string, total string, dropped int, row int, kept boolean"

LONG = " ".join(f"word{i % 997}" for i in range(30_000))

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "the quick  brown\tfox jumps over the lazy dog", None, "a", None),
    (3, "the quick brown fox jumps over the lazy cat", "en", None, 43),
    (4, None, None, None, None),
    (5, "", "de", "b", 0),
    (6, " \t\n", "de", "b", 3),
    (7, "Ünïcode ßtraße — «quotes» 日本語 🙂", "xx", "c", 30),
    (8, LONG, "en", "c", len(LONG)),
    (9, "one", "en", "c", 3),
    (10, "one two", "en", "c", 7),
    (10, "one two", "en", "c", 7),
    (None, "one two", "en", "c", 7),
    (11, "!!! ??? ... ***", "en", "b", 15),
    (12, LONG + " end", "en", "c", len(LONG) + 4),
]


def frame(spark, rows=AWKWARD, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name, kind in (c.rsplit(" ", 1) for c in CLASH.split(", ")):
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def awkward_copies(n: int, text: str = "a group of copies with a third of all rows in it", first: int = 1000):
    return [(first + i, text, "en", "hot", len(text)) for i in range(n)]
