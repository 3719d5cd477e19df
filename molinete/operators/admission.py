"""Which of many ordered requests on shared stock are accepted, without walking them one by one.

Requests are decided in order; each takes from (or adds to) the stock of its
items, and a guarded line is refused if it would leave its item below zero. A
request is taken whole or not at all.

Each round bounds the stock in front of every undecided line: from below as if
all earlier undecided withdrawals were accepted and no earlier undecided receipt,
from above the other way round. A line that fits the lower bound fits for certain,
one that fails the upper bound fails for certain. Such rounds go on for as long as they decide a quarter of what is open.

What is open then waits for scarce items. A request whose open lines wait for just one other request is
accepted with it, or exactly if it is not: such links are followed by doubling, so a chain of any length
costs a step for each binary digit of it. Requests that share no item, not even through others, do not
touch one another, so the open ones fall into connected components, and each component is folded
in request order: its first ``CHAIN`` requests are decided exactly at once. Rounds are cut with a written table.

Requests of one line need no rounds while no item has more than ``HEAD`` lines: these stream through one task in order, whose memory holds the stock of one item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.operators.components import components, follow_links
from molinete.operators.running import HOT_ROWS, Running, row_numbers, running, size_probe
from molinete.session import durable

ORDER = ["requested_at", "request_id"]
LEVEL = "decimal(20,3)"
CHAIN = 500  # requests of a component that are folded exactly in one round
HEAD = HOT_ROWS  # lines per item that are folded exactly in one round, in a stream (single-line requests)


def _level(c: Column) -> Column:
    """Thousandths, as whole numbers: they are added up without decimal arithmetic."""
    return (c.cast(LEVEL) * 1000).cast("bigint")


def _bounded(work: DataFrame, hot_rows: int, sizes: tuple[int, int], need: str = "") -> DataFrame:
    """Undecided lines with ``base`` brought up to date and their stock bounds ``low`` and ``high``.

    ``work`` holds undecided lines and those accepted in the round before. ``need``: ``ahead`` counts the open lines in front, ``rival`` tells
    how many of them can take and the last of these.
    """
    zero = F.lit(0).cast("bigint")
    open_ = (F.col("state") == "open") & ~F.col("dry")
    sums = {
        "_taken": F.when((F.col("state") == "accepted") & ~F.col("dry"), F.col("delta")),
        "_down": F.when(open_, F.least("delta", zero)),
        "_up": F.when(open_, F.greatest("delta", zero)),
    }
    outputs = {n: Running("sum", F.coalesce(v, zero), inclusive=False) for n, v in sums.items()}
    if need == "ahead":
        outputs["_ahead"] = Running("sum", F.when(F.col("state") == "open", F.lit(1)).otherwise(F.lit(0)), inclusive=False)
    if need == "rival":
        outputs["_rivals"] = Running("sum", F.when(open_, F.lit(1)).otherwise(F.lit(0)), inclusive=False)
        outputs["_rival"] = Running("max", F.when(open_, F.struct(*ORDER)), inclusive=False)
    seen = running(work, ["item_id"], ORDER, outputs, hot_rows=hot_rows, sizes=sizes)
    return (
        seen.filter("state = 'open'")
        .withColumn("base", F.col("base") + F.coalesce("_taken", zero))
        .withColumn("low", F.col("base") + F.coalesce("_down", zero))
        .withColumn("high", F.col("base") + F.coalesce("_up", zero))
        .withColumn("fits", ~F.col("guarded") | (F.col("low") + F.col("delta") >= 0))
        .withColumn("fails", F.col("guarded") & (F.col("high") + F.col("delta") < 0))
        .drop("_taken", "_down", "_up")
    )


_LINE = ["request_id", "requested_at", "item_id", "delta", "guarded", "dry", "base"]


def _by_request(bounded: DataFrame) -> DataFrame:
    # Over the request's own lines, so that the bounds are worked out and moved once.
    own = Window.partitionBy("request_id")
    state = F.when(F.bool_or("fails").over(own), "rejected").when(F.bool_and("fits").over(own), "accepted").otherwise("open")
    return bounded.filter("request_id IS NOT NULL").select(*_LINE, state.alias("state"))


def _by_link(bounded: DataFrame) -> DataFrame:
    """As :func:`_by_request`; besides, what waits for one other request is decided with it, however long the chain.

    A line that is open and has one open line in front fits in one of two cases: that request is accepted or it is not.
    """
    waits = ~F.col("fits") & ~F.col("fails")
    # What the one in front would take away makes the lower bound; what it would add, the upper one.
    on = F.when(waits, F.struct(F.when(F.col("_rivals") == 1, F.col("_rival.request_id")).alias("on"), (F.col("low") < F.col("base")).alias("flip")))
    found = bounded.groupBy("request_id").agg(
        F.bool_or("fails").alias("fails"), F.bool_and("fits").alias("fits"), F.min(on).alias("lo"), F.max(on).alias("hi")
    )
    alone = F.col("lo.on").isNotNull() & F.coalesce(F.col("lo.on") == F.col("hi.on"), F.lit(False))
    torn = alone & (F.col("lo.flip") != F.col("hi.flip"))  # one line needs the other request, one needs it refused
    state = F.when(F.col("fails") | torn, "rejected").when(F.col("fits"), "accepted").otherwise("open")
    verdicts = durable(found.select("request_id", state.alias("state"), F.when((state == "open") & alone, F.col("lo")).alias("link")))
    links = verdicts.where("link IS NOT NULL").select(F.col("request_id").alias("id"), "link.on", "link.flip")
    if not links.isEmpty():
        ends = verdicts.select(F.col("request_id").alias("on"), F.col("state").alias("end"))
        told = follow_links(links).join(ends, "on").where("end <> 'open'")
        told = told.select(F.col("id").alias("request_id"), F.when((F.col("end") == "accepted") != F.col("flip"), "accepted").otherwise("rejected").alias("told"))
        verdicts = verdicts.join(told, "request_id", "left").select("request_id", F.coalesce("told", "state").alias("state"))
    return bounded.select(*_LINE).join(verdicts.select("request_id", "state"), "request_id")


def _by_component(bounded: DataFrame, hot_rows: int, few: bool) -> DataFrame:
    """Open lines with their state: the first ``CHAIN`` requests of every connected component are folded exactly; of ``few``, all as one."""
    request, item = F.col("request_id") * 2, F.col("item_id") * 2 + 1
    line = F.struct("item_id", "delta", "guarded", "dry", "base")
    whole = bounded.groupBy(*ORDER).agg(F.collect_list(line).alias("lines"))
    if few:
        turns = whole.withColumns({"component": F.lit(0), "turn": F.lit(1)})
    else:
        roots = components(bounded.select(request.alias("a"), item.alias("b"))).withColumnRenamed("root", "component")
        joined = whole.join(roots, request == F.col("node")).drop("node")
        turns = durable(row_numbers(joined, ["component"], ORDER, "turn", hot_rows=hot_rows))
    chains = (
        turns.filter(F.col("turn") <= CHAIN)
        .groupBy("component")
        .agg(F.sort_array(F.collect_list(F.struct(*ORDER, "lines"))).alias("requests"))
        .withColumn("items", F.array_distinct(F.flatten(F.transform("requests", lambda r: F.transform(r["lines"], lambda x: x["item_id"])))))
    )
    zero = F.lit(0).cast("bigint")
    at = lambda x: F.array_position("items", x["item_id"])
    start = F.struct(F.transform("items", lambda _: zero).alias("extra"), F.array().cast("array<boolean>").alias("taken"))

    def step(s: Column, r: Column) -> Column:
        take = F.forall(r["lines"], lambda x: ~x["guarded"] | (x["base"] + F.element_at(s["extra"], at(x).cast("int")) + x["delta"] >= 0))

        def moved(extra: Column, x: Column) -> Column:
            return F.transform(extra, lambda v, i: v + F.when((i + 1 == at(x)) & ~x["dry"], x["delta"]).otherwise(zero))

        return F.struct(F.when(take, F.aggregate(r["lines"], s["extra"], moved)).otherwise(s["extra"]).alias("extra"), F.concat(s["taken"], F.array(take)).alias("taken"))

    decided = (
        chains.withColumn("taken", F.aggregate("requests", start, step, lambda s: s["taken"]))
        .select(F.inline(F.arrays_zip(F.col("requests.request_id").alias("request_id"), "taken")))
        .select("request_id", F.when(F.col("taken"), "accepted").otherwise("rejected").alias("verdict"))
    )
    return bounded.select(*_LINE).join(decided, "request_id", "left").select(*_LINE, F.coalesce("verdict", F.lit("open")).alias("state"))


def _folded(lines: DataFrame) -> DataFrame:
    """Single-line requests with their state: the lines of an item go by one task in order, which holds nothing but the item's stock."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, extra = None, 0
        for batch in batches:
            states = []
            for item, delta, guarded, dry, base in zip(*(batch.column(c).to_pylist() for c in _LINE[2:]), strict=True):
                if item != now:
                    now, extra = item, 0
                take = not guarded or base + extra + delta >= 0
                if take and not dry:
                    extra += delta
                states.append("accepted" if take else "rejected")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _LINE), pa.array(states, pa.string())], [*_LINE, "state"])

    dealt = lines.select(*_LINE, F.lit("").alias("state"))
    in_order = dealt.drop("state").repartition("item_id").sortWithinPartitions("item_id", *ORDER, *_LINE[3:])
    return in_order.mapInArrow(fold, dealt.schema)


def _by_line(bounded: DataFrame) -> DataFrame:
    """Single-line requests: the first lines of every item are folded exactly, the others use their bounds."""
    ahead = F.coalesce("_ahead", F.lit(0))
    loose = bounded.filter(ahead >= HEAD).withColumn(
        "state", F.when(F.col("fails"), "rejected").when(F.col("fits"), "accepted").otherwise("open")
    )
    return _folded(bounded.filter(ahead < HEAD)).unionByName(loose.select(*_LINE, "state"))


def admit(
    lines: DataFrame, stock: DataFrame, *, single_line: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``request_id, accepted`` for every request.

    ``lines``: ``request_id, requested_at, item_id, delta, guarded``, one per request and item
    (``single_line``: one per request). ``stock``: ``item_id, stock``, every item present. Lines with an
    optional ``dry`` flag are judged in their turn but take nothing.
    """
    if "dry" not in lines.columns:
        lines = lines.withColumn("dry", F.lit(False))
    stocked = lines.join(stock.select("item_id", F.col("stock").alias("base")), "item_id")
    work = durable(
        stocked.select(
            *[c if c not in ("delta", "base") else _level(F.col(c)).alias(c) for c in _LINE],
            F.lit("open").alias("state"),
        )
    )
    sizes = size_probe(work, ["item_id"])
    if single_line and sizes[1] <= HEAD:
        return durable(_folded(work).select("request_id", (F.col("state") == "accepted").alias("accepted")))
    decided, waiting, stuck, few = [], sizes[0], 0, False
    while True:
        if single_line:
            judged = _by_line(_bounded(work, hot_rows, sizes, "ahead"))
        elif few:
            judged = _by_component(_bounded(work, hot_rows, sizes), hot_rows, True)
        elif not stuck:
            judged = _by_request(_bounded(work, hot_rows, sizes))
        elif stuck == 1:
            judged = _by_link(durable(_bounded(work, hot_rows, sizes, "rival")))
        else:
            judged = _by_component(durable(_bounded(work, hot_rows, sizes)), hot_rows, False)
        judged = durable(judged)
        decided.append(
            judged.filter("state <> 'open'").select("request_id", (F.col("state") == "accepted").alias("accepted"))
        )
        open_ = judged.filter("state = 'open'").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("request_id").alias("requests")).first()
        left, few = open_["lines"], not single_line and open_["requests"] <= CHAIN
        if not left:
            break
        # Bounds go on for as long as they decide a quarter of what is open; where they do not, links are next, and a fold where these do not either.
        stuck, waiting = (stuck + 1) % 3 if left > 0.75 * waiting else 0, left
        work = judged.filter("state <> 'rejected'")
        if sizes[1] > hot_rows:  # what is left may have no hot item any more
            sizes = size_probe(work, ["item_id"])
    every = reduce(DataFrame.unionByName, decided)
    return every if single_line else every.distinct()
