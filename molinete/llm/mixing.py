"""Mixing sources to target weights with DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.llm.common import durable, fresh, running_before, word_count

#: The first hex digits of a key that name its slice: 4,096 slices of a source's order, each a range of keys.
SLICE_DIGITS = 3


def source_targets(catalogue: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``catalogue`` (one row per source: ``source_null``, ``source_name``, ``total``) with each source's ``target``.

    Sources by code point, null last, take the weights in turn. The sum of all totals is shared by weight; a
    target stops at ``repeats`` times its source's total and the excess is shared again among the rest. Sorted by the level at
    which each stops, a source stops if its limit is below its share of what those before it leave: one pass, no rounds.
    The catalogue (one short row per source) is sorted in one task; documents never are.
    """
    common = math.prod(weights)
    place = F.row_number().over(Window.orderBy("source_null", "source_name"))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (place - 1) % len(weights) + 1)
    named = catalogue.withColumn("weight", weight).withColumn("limit", F.col("total") * repeats)
    by_level = Window.orderBy(F.expr(f"limit * ({common} div weight)"), "source_null", "source_name")
    all_of = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(all_of) - F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = named.select("*", left.alias("left"), F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"))
    # The first source that does not stop fixes the level for itself and all after it.
    opened = ranked.withColumn("open", F.col("limit") * F.col("left_weight") > F.col("left") * F.col("weight"))
    level = [F.first(F.when(F.col("open"), F.col(c)), ignorenulls=True).over(all_of).cast("double") for c in ("left", "left_weight")]
    share = F.col("weight").cast("double") * level[0] / level[1]
    return opened.select("source_null", "source_name", "total", F.when(F.col("open"), share).otherwise(F.col("limit").cast("double")).alias("target"))


def _placed(docs: DataFrame, seed: str, weights: tuple[int, ...], repeats: int, doc_id: str, size: str, source: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the words before each in its source's key order, its source's total and target."""
    new = ("source_null", "source_name", "mix_key", "words_before", "total", "target")
    name = dict(zip(new, fresh(docs, *new), strict=True))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    keyed = (
        docs.withColumn(name["source_null"], F.col(source).isNull())
        .withColumn(name["source_name"], F.coalesce(F.col(source).cast("string"), F.lit("")))
        .withColumn(name["mix_key"], key)
    )

    def budgets(catalogue: DataFrame) -> DataFrame:
        plain = catalogue.toDF("source_null", "source_name", "total")
        return source_targets(plain, weights=weights, repeats=repeats).toDF(*(name[c] for c in ("source_null", "source_name", "total", "target")))

    part = F.conv(F.substring(name["mix_key"], 1, SLICE_DIGITS), 16, 10).cast("int")
    by = [name["source_null"], name["source_name"]]
    return running_before(keyed, by, [name["mix_key"], doc_id, size], part, size, name["words_before"], per_key=budgets), name


def _passes(name: dict[str, str]) -> tuple[Column, Column]:
    """Whole passes over a source, and the words of its budget (the target, rounded) that are left after them."""
    budget = f"cast(floor(`{name['target']}` + 0.5d) as bigint)"
    passes = F.expr(f"{budget} div greatest(`{name['total']}`, 1)")
    return passes, F.expr(budget) - passes * F.col(name["total"])


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: how many words of each document the mix takes, repeats counted.

    Every document has a key by hash of its id. A source's documents in key order are read again and again until its
    budget (the target, rounded) is used up. All passes but the last take a document whole; the last takes what is left of the
    budget when its turn comes, so the budget is met to the word and only the document at the cut is taken in part. Ranges
    of keys are the slices of the order, each sorted by its own task. Sizes are shuffled, not texts.

    Null texts have size 0. Null sources are one source. Rows that repeat an id stand side by side in the order. A
    source without words has target 0. An empty table gives no rows. Other columns are not read.
    """
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    placed, name = _placed(durable(sizes), seed, weights, repeats, "doc_id", "size", "source")
    passes, rest = _passes(name)
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col(name["words_before"])))
    return placed.select(
        "doc_id", "size", F.col(name["total"]).alias("source_size"), F.col(name["target"]).alias("target"), (passes * F.col("size") + last).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix as rows of ``docs``, whole texts: a document taken twice is two rows, one not taken is none.

    As :func:`mix_sources`, except that the document at the cut is taken whole if at least half of it fits the budget, so a
    source differs from its budget by half that document at most. Documents without words have nothing to mix and
    stay, once.
    """
    size, turn = fresh(docs, "size", "turn")
    placed, name = _placed(docs.withColumn(size, word_count(text)), seed, weights, repeats, doc_id, size, source)
    passes, rest = _passes(name)
    more = (rest > 0) & (2 * (rest - F.col(name["words_before"])) >= F.col(size))
    times = F.when(F.col(size) == 0, F.lit(1)).otherwise(passes + more.cast("long")).cast("int")
    return placed.where(times > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
