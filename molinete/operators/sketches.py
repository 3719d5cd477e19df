"""Distinct counts that add up: a sketch a day, merged to any period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** LG_K registers a sketch: at most 16 KB each, whatever it has seen.
LG_K = 14
#: Three standard errors of an estimate, as a share of the true count.
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def daily_sketches(facts: DataFrame, ts: str, what: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, day, sketch, n)``: who was there, per day. Made in every task before anything moves; a late day is sketched again alone."""
    return facts.groupBy(*by, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(what, F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def distinct_over(sketches: DataFrame, period: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by, period, distinct, n)``: estimates for any grouping of the days, from the sketches alone."""
    merged = sketches.groupBy(*by, period.alias("period")).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*by, "period", F.hll_sketch_estimate("sketch").alias("distinct"), "n")
