"""Connected components of a link table, by large stars and small stars; chains of links, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.session import durable


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Each node hands the smallest of its neighbours to the others: to larger ones (large star) or to itself and smaller ones.

    The minimum is merged per task before its shuffle and then written, so that links and minima meet as two plain scans: the
    skew join splits a node that holds a third of the links.
    """
    sides = links.union(links.select("b", "a")) if not small else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = durable(sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")))
    met = sides.join(lowest, "a")
    if small:
        own = lowest.select(F.col("a"), F.col("low"))
        out = met.select(F.col("b").alias("a"), "low").union(own)
    else:
        out = met.where("b > a").select(F.col("b").alias("a"), "low")
    return out.where("a <> low").select("a", F.col("low").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``a``, ``b``: longs): ``root`` is the smallest node it reaches.

    Rounds grow with the logarithm of the longest chain; each is written to the shared checkpoint folder, so a lost
    executor costs a re-read. The driver sees one number per round. Self links and repeated links do no harm; an empty table
    gives no rows.
    """
    edges = durable(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        edges = durable(_star(durable(_star(edges, small=False)), small=True))
        # A forest of stars no longer changes: compare counts and sums of what a node points to.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now


def follow_links(links: DataFrame) -> DataFrame:
    """``(id, on, flip)`` with ``on`` the end of each chain, from ``(id, on, flip)``, one link per ``id``; ``flip`` is turned once for every link that has it.

    Each step doubles how far a link reaches, so a chain takes as many steps as its length has binary digits. Links must not go round.
    """
    state = durable(links)
    while True:
        ahead = state.select(F.col("id").alias("on"), F.col("on").alias("next"), F.col("flip").alias("turn"))
        further = state.join(ahead, "on", "left").select(
            "id", F.coalesce("next", "on").alias("on"), (F.col("flip") != F.coalesce("turn", F.lit(False))).alias("flip"), F.col("next").isNotNull().alias("moved")
        )
        state = durable(further)
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")
