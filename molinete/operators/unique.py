"""Which of many changes may take the unique values they ask for, as if applied one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.operators.components import follow_links
from molinete.session import durable

def _never() -> Column:
    """Later than any change."""
    return F.struct(F.lit(1).alias("never"), F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(None).cast("bigint").alias("id"))


def last_requested(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last change of each id (equal times: the largest row), and the others as ``(id, reason)``."""
    rest = [c for c in changes.columns if c not in ("id", "requested_at")]
    latest = Window.partitionBy("id").orderBy(F.desc("requested_at"), *[F.desc(c) for c in rest])
    numbered = changes.withColumn("_turn", F.row_number().over(latest))
    return numbered.filter("_turn = 1").drop("_turn"), numbered.filter("_turn > 1").select("id", F.lit("superseded").alias("reason"))


def _at(prefix: str = "") -> Column:
    return F.struct(F.lit(0).alias("never"), F.col(f"{prefix}requested_at").cast("timestamp_ntz").alias("t"), F.col(f"{prefix}id").cast("bigint").alias("id"))


def _judged(claims: DataFrame, held: DataFrame, state: DataFrame) -> DataFrame:
    """``(id, place, certain, waits)`` per claim, from what is decided so far.

    A value is taken if another row holds it and has not given it up before, or an earlier accepted change took it. ``waits`` names open
    changes that decide it, as ``(on, flip)``: the claim needs a holder's change to be accepted, and an earlier claimant's (``flip``) not to be. The holders
    of a value come down to the three that keep it longest and its open claimants to the first two, so a value that everybody wants is no pair
    of all with all; that a change waits for more than one other is known all the same.
    """
    decided = state.select(F.col("id").alias("_id"), "accepted")
    fate = F.when(F.col("_id").isNull(), F.lit(True)).otherwise(F.col("accepted"))  # a change that claims nothing is not refused
    release = held.join(decided, held["id"] == F.col("_id"), "left").select(
        "place",
        "key",
        "id",
        # A change still open gives the value up at its time or never.
        F.when(F.col("moves") & F.coalesce(fate, F.lit(True)), _at()).otherwise(_never()).alias("soonest"),
        F.when(F.col("moves") & F.coalesce(fate, F.lit(False)), _at()).otherwise(_never()).alias("latest"),
    )
    longest = Window.partitionBy("place", "key").orderBy(F.desc("latest"), F.desc("soonest"), F.desc("id"))
    holders = release.withColumn("n", F.row_number().over(longest)).where("n <= 3")
    holders = holders.groupBy("place", "key").agg(F.collect_list(F.struct("id", "soonest", "latest")).alias("holders"))
    known = claims.join(decided, claims["id"] == F.col("_id"), "left").select("place", "key", "accepted", _at().alias("at"))
    taken = known.where("accepted").groupBy("place", "key").agg(F.min("at").alias("taken_at"))
    soonest = Window.partitionBy("place", "key").orderBy("at")
    open_ = known.where("accepted IS NULL").withColumn("n", F.row_number().over(soonest)).where("n <= 2")
    open_ = open_.groupBy("place", "key").agg(F.collect_list("at").alias("open"))
    out = claims.join(holders, ["place", "key"], "left").join(taken, ["place", "key"], "left").join(open_, ["place", "key"], "left")
    # The row's own hold is no conflict.
    others = F.filter(F.coalesce("holders", F.array().cast(holders.schema["holders"].dataType)), lambda h: h["id"] != F.col("id"))
    kept = F.exists(others, lambda h: h["soonest"] > _at())
    releasing = F.transform(F.filter(others, lambda h: h["latest"] > _at()), lambda h: F.struct(h["id"].alias("on"), F.lit(False).alias("flip")))
    earlier = F.filter(F.coalesce("open", F.array().cast(open_.schema["open"].dataType)), lambda t: t < _at())
    before = F.transform(earlier, lambda t: F.struct(t["id"].alias("on"), F.lit(True).alias("flip")))
    certain = kept | F.coalesce(F.col("taken_at") < _at(), F.lit(False))
    return out.select("id", "place", certain.alias("certain"), F.when(~certain, F.concat(releasing, before)).alias("waits"))


def settle_claims(claims: DataFrame, held: DataFrame) -> DataFrame:
    """``(id, place)`` of the claims that fail; a change with any of them is rejected and gives nothing up.

    ``claims``: ``id, requested_at, place, key``, the values that valid changes ask for, one change per id; ``place`` says which unique column.
    ``held``: ``id, requested_at, place, key, moves``, the values that rows have now; ``moves`` if the row has a valid change at
    ``requested_at`` that gives this value up. Changes are in the order of ``(requested_at, id)``.

    Each round decides every change whose conflicts are certain either way; the earliest open one always is, so the rounds end. A change that
    waits for just one other is accepted with it, or exactly if it is not: a link. Chains of links are followed by doubling, so a thousand changes that
    each wait for the one before take ten steps of one round. Rounds are only needed for changes that wait for several others, one for each
    layer of them.
    """
    claims, held = durable(claims), durable(held)
    state = durable(claims.select("id").distinct().withColumn("accepted", F.lit(None).cast("boolean")))
    while True:
        found = _judged(claims, held, state).groupBy("id").agg(
            F.max("certain").alias("certain"), F.min(F.array_min("waits")).alias("lo"), F.max(F.array_max("waits")).alias("hi")
        )
        alone = F.col("lo.on") == F.col("hi.on")
        # To need a change and need it not to be is more than it can be.
        verdict = F.when(F.col("certain"), F.lit(False)).when(F.col("lo").isNull(), F.lit(True)).when(alone & (F.col("lo.flip") != F.col("hi.flip")), F.lit(False))
        link = F.col("accepted").isNull() & verdict.isNull() & alone
        seen = durable(
            state.join(found, "id").select(
                "id", F.coalesce("accepted", verdict).alias("accepted"), F.when(link, F.col("lo.on")).alias("on"), F.when(link, F.col("lo.flip")).alias("flip")
            )
        )
        links = seen.where("on IS NOT NULL").select("id", "on", "flip")
        state = seen.select("id", "accepted")
        if not links.isEmpty():
            ends = state.select(F.col("id").alias("on"), F.col("accepted").alias("end"))
            told = follow_links(links).join(ends, "on").select(F.col("id").alias("_id"), (F.col("end") != F.col("flip")).alias("told"))
            state = durable(state.join(told, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("accepted", "told").alias("accepted")))
        if state.where("accepted IS NULL").isEmpty():
            break
    return _judged(claims, held, state).where("certain").select("id", "place")
