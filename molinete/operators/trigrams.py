"""An index for ``LIKE %term%``: three letters at a time, as search folds them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import fold, matches
from molinete.session import durable

#: Of a term's three-letter parts so many, the rarest, are looked up.
LOOKED_UP = 3


@dataclass(frozen=True)
class Index:
    """``grams``: ``(gram, key)``, sorted by gram, so that a lookup reads the row groups of its grams. ``sizes``: ``(gram, n)``."""

    key: str
    columns: tuple[str, ...]
    grams: DataFrame
    sizes: DataFrame


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a folded text."""
    places = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(3)))))


def build_index(df: DataFrame, key: str, columns: Sequence[str]) -> Index:
    """Three-letter parts of ``columns``, folded as :func:`matches` folds them, with the ``key`` of the rows that have them; null texts have none.

    Postings are rows dealt by ranges of (gram, key), so a part that a third of all rows share fills many tasks and files.
    """
    each = [F.coalesce(grams_of(fold(c)), F.array().cast("array<string>")) for c in columns]
    text = F.array_distinct(F.flatten(F.array(*each)))
    postings = df.select(F.explode(text).alias("gram"), F.col(key).alias("key"))
    grams = durable(postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"))
    return Index(key, tuple(columns), grams, durable(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))


def term_grams(df: DataFrame, term: str) -> list[str]:
    """What a text must hold to match: the three-letter parts of the term between its wildcards, folded."""
    folded = df.sparkSession.range(1).select(fold(F.lit(term))).first()[0]
    return sorted({part[i : i + 3] for part in re.split(r"[%_\\]", folded) for i in range(len(part) - 2)})


def candidates(index: Index, df: DataFrame, term: str) -> DataFrame:
    """Rows of ``df`` that hold the rarest three-letter parts of ``term``; all rows if it has no such part."""
    grams = term_grams(df, term)
    if not grams:
        return df
    sizes = {r["gram"]: r["n"] for r in index.sizes.filter(F.col("gram").isin(grams)).collect()}  # as many as the term has parts
    if len(sizes) < len(grams):
        return df.limit(0)  # a part that no row has
    rarest = sorted(grams, key=lambda g: (sizes[g], g))[:LOOKED_UP]
    hits = index.grams.filter(F.col("gram").isin(rarest)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest))
    return df.join(hits.select(F.col("key").alias(index.key)), index.key, "left_semi")


def indexed_search(index: Index, df: DataFrame, term: str | None) -> DataFrame:
    """The rows that :func:`text_search` finds in the index's columns, compared only where the index leaves it open."""
    text = (term or "").strip()
    return candidates(index, df, text).filter(matches(index.columns, text)) if text else df
