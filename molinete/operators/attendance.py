"""Attendance operators: as-of attribution, gaps, and the entry cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.scalars import epoch_seconds
from molinete.operators.running import HOT_ROWS, Running, running
from molinete.session import durable

COOLDOWN_MINUTES = 30
DAY = 86_400


def attribute_entries(
    entries: DataFrame, memberships: DataFrame, *, ts: str = "entered_at", how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each entry with the client's membership in force that day, latest ``end_date`` first.

    Membership starts and entries stand in one order of time per client. The greatest ``(end_date, id)`` of the memberships started so far is the
    answer if it ends on or after the day; if it does not, none is in force. ``how='left'`` keeps entries without one; ``'inner'`` drops them.
    """
    row = F.struct(*[F.col(c) for c in entries.columns if c not in ("membership_id", "client_id")])
    ending = F.struct("end_date", F.col("id").cast("bigint").alias("membership_id"))
    swipes = entries.select("client_id", F.col(ts).cast("timestamp_ntz").alias("_t"), F.col("id").cast("bigint").alias("_seq"), row.alias("_row"))
    swipes = swipes.withColumn("_m", F.lit(None).cast("struct<end_date:date,membership_id:bigint>"))
    started = memberships.filter("status = 'active' AND client_id IS NOT NULL AND start_date IS NOT NULL").select(
        "client_id",
        F.col("start_date").cast("timestamp_ntz").alias("_t"),
        F.lit(-(1 << 63)).cast("bigint").alias("_seq"),  # a membership counts for an entry at the very start of its first day
        F.lit(None).cast(swipes.schema["_row"].dataType).alias("_row"),
        ending.alias("_m"),
    )
    out = running(swipes.unionByName(started), ["client_id"], ["_t", "_seq"], {"_best": Running("max", F.col("_m"))}, hot_rows=hot_rows)
    day = F.to_date(F.col(f"_row.{ts}"))
    covered = F.col("_best.end_date") >= day
    found = out.filter("_row IS NOT NULL").select(
        "client_id",
        day.alias("entry_day"),
        *[F.col(f"_row.{c}").alias(c) for c in entries.columns if c not in ("membership_id", "client_id")],
        F.when(covered, F.col("_best.membership_id")).alias("membership_id"),
        F.when(covered, F.col("_best.end_date")).alias("membership_end_date"),
    )
    return found.filter("membership_id IS NOT NULL") if how == "inner" else found


def entry_gaps(entries: DataFrame, *, ts: str = "entered_at", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``minutes_since_previous``: whole minutes since the client's previous entry, NULL for the first."""
    out = running(
        entries,
        ["client_id"],
        [ts, "id"],
        {"previous_entered_at": Running("max", F.col(ts), inclusive=False)},
        hot_rows=hot_rows,
    )
    seconds = epoch_seconds(ts) - epoch_seconds("previous_entered_at")
    return out.withColumn("minutes_since_previous", F.floor(seconds / 60).cast("bigint"))


def _chain(seconds: Column, start: Column, cooldown: int) -> Column:
    """Last accepted second when ``start`` is accepted and the rest follow greedily."""
    return F.aggregate(seconds, start, lambda last, s: F.when(s >= last + cooldown, s).otherwise(last))


def _day_links(days: DataFrame, cooldown: int) -> DataFrame:
    """``days`` with ``starts``, the swipes that may be a day's first accepted one, and ``to``, what each start makes of the next day.

    ``to`` holds for each start the place of the next day's start among its own (their number: none), and is NULL where the next day
    starts free: there is none, or its first swipe comes a cooldown after this day's last.
    """
    opens = F.col("day") * DAY + cooldown
    late = F.filter("secs", lambda s: s >= opens)
    starts = F.concat(F.filter("secs", lambda s: s < opens), F.slice(late, 1, 1))
    linked = days.withColumn("starts", starts).withColumn("lasts", F.transform("starts", lambda s: _chain(F.col("secs"), s, cooldown)))
    following = linked.select("client_id", (F.col("day") - 1).alias("day"), F.col("starts").alias("_next"))
    to = F.transform("lasts", lambda last: F.size(F.filter("_next", lambda s: s < last + cooldown)))
    bound = F.get("_next", F.lit(0)) < F.element_at("secs", -1) + cooldown
    return linked.join(following, ["client_id", "day"], "left").select("client_id", "day", "secs", "starts", F.when(bound, to).alias("to"))


def _day_starts(links: DataFrame) -> DataFrame:
    """``(client_id, day, at)``: the place of the start that each day truly has.

    Days that start free have their first. Where all starts of a day make the same of the next, that is known too. What is left are runs of
    days through which every start still matters: their maps are composed by doubling, so that after ``n`` rounds a day that is known
    has told the days up to ``2 ** n`` behind it. A row holds one map of one day whatever the client's share of the swipes.
    """
    before = links.select("client_id", (F.col("day") + 1).alias("day"), F.col("to").alias("_from"))
    same = F.array_min("_from") == F.array_max("_from")
    at = F.when(F.col("_from").isNull(), F.lit(0)).when(same, F.array_min("_from"))
    known = durable(links.select("client_id", "day", "to").join(before, ["client_id", "day"], "left").select("client_id", "day", "to", at.alias("at")))
    tells = F.col("to").isNotNull() & (F.array_min("to") != F.array_max("to"))
    first = known.where("at IS NOT NULL").select("client_id", "day", "at")
    if known.where("at IS NULL").isEmpty():
        return first
    state, step = known.where(F.col("at").isNull() | tells), 1
    while not state.where("at IS NULL").isEmpty():
        ahead = state.select("client_id", (F.col("day") - step).alias("day"), F.col("to").alias("_ahead"))
        behind = state.where("at IS NOT NULL AND to IS NOT NULL").select("client_id", (F.col("day") + step).alias("day"), F.get("to", F.col("at")).alias("_told"))
        composed = F.when(F.col("_ahead").isNotNull(), F.transform("to", lambda x: F.get("_ahead", x)))
        joined = state.join(ahead, ["client_id", "day"], "left").join(behind, ["client_id", "day"], "left")
        state = durable(joined.select("client_id", "day", composed.alias("to"), F.coalesce("at", "_told").alias("at")))
        step *= 2
    late = known.where("at IS NULL").select("client_id", "day").join(state.select("client_id", "day", "at"), ["client_id", "day"])
    return first.unionByName(late)


def cooldown_accepted(
    swipes: DataFrame, *, minutes: int = COOLDOWN_MINUTES, last_entries: DataFrame | None = None
) -> DataFrame:
    """``(client_id, sec)`` of the accepted swipes: each at least ``minutes`` after the last accepted one.

    ``swipes`` has ``client_id`` and ``sec`` (whole seconds, the precision entries
    are stored with); ``last_entries`` has ``client_id`` and ``sec`` of earlier entries.

    The chain is sequential per client but not per row: it is folded in groups of
    one client and one day. Two swipes in one second cannot both be accepted, so
    such a group has at most 86,400 distinct seconds whatever the client's share
    of the rows. What a day passes on depends only on its first accepted swipe,
    which is one of those in the first ``minutes`` or the first one after them: a day is
    a map from its starts to those of the next day. The maps are composed by doubling
    (no two days of a client ever meet in one row), and each day is replayed once from its true start.
    """
    cooldown = minutes * 60
    if last_entries is not None:
        # What comes too soon after an earlier entry is out, whatever else is accepted; the rest starts free.
        known = last_entries.groupBy("client_id").agg((F.max("sec") + cooldown).alias("_free_at"))
        free = F.col("_free_at").isNull() | (F.col("sec") >= F.col("_free_at"))
        swipes = swipes.join(known, "client_id", "left").filter(free)
    days = (
        swipes.select("client_id", "sec", F.floor(F.col("sec") / DAY).alias("day"))
        .groupBy("client_id", "day")
        .agg(F.sort_array(F.collect_set("sec")).alias("secs"))
    )
    links = durable(_day_links(days, cooldown))

    def accept(taken: Column, s: Column) -> Column:
        last = F.try_element_at(taken, F.lit(-1))
        return F.when(F.coalesce(s >= last + cooldown, s >= F.col("first")), F.concat(taken, F.array(s))).otherwise(taken)

    started = links.join(_day_starts(links), ["client_id", "day"]).select("client_id", "secs", F.get("starts", F.col("at")).alias("first"))
    return started.where("first IS NOT NULL").select("client_id", F.explode(F.aggregate("secs", F.array().cast("array<bigint>"), accept)).alias("sec"))


def entry_cooldown(
    swipes: DataFrame,
    *,
    ts: str = "entered_at",
    minutes: int = COOLDOWN_MINUTES,
    last_entries: DataFrame | None = None,
    eligible: Column | None = None,
) -> DataFrame:
    """``swipes`` with ``accepted``; of several in one second the lowest id can be accepted.

    Swipes that are not ``eligible`` are never accepted and hold nothing back.
    """
    able = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    timed = swipes.withColumns({"sec": epoch_seconds(ts), "_able": able})
    known = None
    if last_entries is not None:
        known = last_entries.select("client_id", epoch_seconds(ts).alias("sec"))
    candidates = timed.filter("_able").select("client_id", "sec", "id")
    kept = cooldown_accepted(candidates, minutes=minutes, last_entries=known)
    moment = ["client_id", "sec"]
    winners = candidates.groupBy(*moment).agg(F.min("id").alias("_winner")).join(kept, moment, "left_semi")
    won = F.col("_able") & F.coalesce(F.col("id") == F.col("_winner"), F.lit(False))
    return timed.join(winners, moment, "left").withColumn("accepted", won).drop("sec", "_able", "_winner")
