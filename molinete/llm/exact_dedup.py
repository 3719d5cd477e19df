"""Exact duplicates: grouped by a 128-bit hash of the normalised text, compared byte by byte inside a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.llm.common import durable, fresh, text_of


def normalised(text: Column | str) -> Column:
    """The text with each run of white space replaced by one space (not trimmed); null is empty."""
    return F.regexp_replace(text_of(text), r"[ \t-\r]{2,}|[\t-\r]", " ")


def content_hash(text: Column) -> Column:
    """128 bits of the content, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Copies are merged per task by (hash, bytes) before the only shuffle of texts, so a group with a third of all rows
    sends one text per task; two texts under one hash stay two classes because the bytes are part of the key. Each document
    then finds its class by (hash, SHA-256), two short columns. Should two different texts ever agree in both digests, the query
    stops rather than merge them. The class table is written first, so that both sides of the join are plain
    scans and a hot class is split by the skew join.

    Null and empty texts are one class. Of rows that repeat one id with one text, the first counts as kept. A null id is
    larger than any other; rows whose class has only null ids keep one of them, with a null ``keep_id``. An empty table
    gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("body"))
    classes = durable(
        texts.groupBy(digest(F.col("body")).alias("hash"), "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("hash", "text_sha256")
        .agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share both digests"))))
        .drop("texts")
    )
    rows = (
        texts.select("doc_id", digest(F.col("body")).alias("hash"), F.sha2("body", 256).alias("text_sha256"))
        .groupBy("doc_id", "hash", "text_sha256")
        .agg(F.count("*").alias("times"))
    )
    return (
        rows.join(classes, ["hash", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the smallest id of each class of equal texts.

    The same grouping as :func:`exact_groups`, keyed by hash and bytes. Each task sends at most one row per class it has seen.
    """
    digest_, body, turn = fresh(docs, "hash", "body", "turn")
    first = Window.partitionBy(digest_, body).orderBy(F.col(doc_id).asc_nulls_last())
    return (
        docs.withColumn(body, normalised(text))
        .withColumn(digest_, digest(F.col(body)))
        .withColumn(turn, F.row_number().over(first))
        .where(F.col(turn) == 1)
        .select(*docs.columns)
    )
