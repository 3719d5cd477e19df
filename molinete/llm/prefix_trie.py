"""The prefix trie of conversations: blocks of turns are grouped by digest first, turns only where sibling blocks diverge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, text_of
from molinete.operators.running import Running, running, size_probe

#: Turns of a block.
BLOCK = 4

_PIECES = tuple(f"p{i}" for i in range(4))


def number_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, no, digest, n_bytes)``: the turns of each conversation numbered from 1, each with 128 bits of its role and text and its text's UTF-8 bytes.

    Turns are in the order of ``turn``, null first; turns that share a number follow by role, then by digest, and repeated rows are turns of their own.
    A null role or text is the empty one. Rows without a conversation are left out. No text is shuffled, and a
    conversation with a third of all turns is numbered in slices.
    """
    who, said = text_of(role), text_of(text)
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes"))
    numbered = running(turns.where(F.col("conv_id").isNotNull()), ["conv_id"], ["turn", "role", "digest"], {"no": Running("count")})
    return numbered.select("conv_id", F.col("no").cast("long").alias("no"), "digest", "n_bytes")


def _named(pieces: list[Column]) -> Column:
    """A node's name: 128 bits, the sum of what its turns give at their places."""
    return F.concat(*[F.lpad(F.lower(F.hex(p % (1 << 32))), 8, "0") for p in pieces])


def _pieces_of(no: Column, digest: Column) -> list[Column]:
    """Four 32-bit numbers of a turn at its place. A prefix is named by their sums, which any number of tasks may add up in parts."""
    mixed = F.md5(F.concat(no.cast("string").cast("binary"), digest))
    return [F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


ROOT = "0" * 32


@dataclass(frozen=True)
class Trie:
    """``nodes``: ``(node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes)``, one row per distinct prefix. A node's text
    is turn ``depth`` of conversation ``conv_id``, the smallest of its members. ``ends``: ``(conv_id, node)``, where each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def _block_groups(turns: DataFrame, block: int) -> DataFrame:
    """``(before, b0..b3, first, turns, conv_id, n)``: the distinct blocks behind each prefix ``before``, with their smallest conversation and how many have them."""
    place = F.struct(F.col("no"), *_PIECES, F.col("n_bytes"))
    blocks = (
        turns.select("conv_id", "no", "n_bytes", *[p.alias(n) for n, p in zip(_PIECES, _pieces_of(F.col("no"), F.col("digest")), strict=True)])
        .groupBy("conv_id", F.floor((F.col("no") - 1) / block).cast("long").alias("block"))
        .agg(F.sort_array(F.collect_list(place)).alias("turns"), *[F.sum(p).alias(p) for p in _PIECES])
    )
    sums = {f"b{i}": Running("sum", F.col(p), inclusive=False) for i, p in enumerate(_PIECES)}
    summed = running(blocks, ["conv_id"], ["block"], sums, sizes=size_probe(turns, ["conv_id"]))
    starts = [F.coalesce(f"b{i}", F.lit(0)) % (1 << 32) for i in range(4)]
    ends = [s + F.col(p) for s, p in zip(starts, _PIECES, strict=True)]
    return (
        summed.select("conv_id", "turns", _named(starts).alias("before"), _named(ends).alias("after"), *[s.alias(f"b{i}") for i, s in enumerate(starts)])
        .groupBy("before", "after")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(4)])
    )


def _adder(piece: str):
    return lambda total, turn: total + turn[piece]


def _prefixes() -> Column:
    """Of a block's turns, the prefix that ends at each: ``(node, parent, depth, n_bytes)``."""

    def upto(i: Column) -> Column:
        """The name of what ends with turn ``i`` (from 0; -1: before the block)."""
        inside = F.slice("turns", F.lit(1), i + 1)
        return _named([F.aggregate(inside, F.col(f"b{k}"), _adder(p)) for k, p in enumerate(_PIECES)])

    return F.transform("turns", lambda t, i: F.struct(upto(i).alias("node"), upto(i - 1).alias("parent"), t["no"].alias("depth"), t["n_bytes"].alias("n_bytes")))


def _trie_nodes(turns: DataFrame, ids: DataFrame, block: int) -> DataFrame:
    """``(node, parent, depth, n_bytes, conv_id, n)``: every distinct prefix, the empty one included."""
    groups = durable(_block_groups(turns, block))
    siblings = groups.groupBy("before").agg((F.count(F.lit(1)) > 1).alias("diverge"))
    marked = groups.join(siblings, "before").select("diverge", "conv_id", "n", F.explode(_prefixes()).alias("p"))
    each = marked.select("diverge", "p.node", "p.parent", "p.depth", "p.n_bytes", "conv_id", "n")
    columns = ["node", "parent", "depth", "n_bytes", "conv_id", "n"]
    # A block alone behind its prefix has the same conversations at each of its turns; only siblings need to be told apart turn by turn.
    straight = each.where(~F.col("diverge")).select(columns)
    refined = each.where("diverge").groupBy("node").agg(*[F.first(c).alias(c) for c in columns[1:4]], F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "conv_id", "n")
    return straight.union(refined.select(columns)).union(root)


def _branch_totals(branches: DataFrame) -> DataFrame:
    """``(branch, saved, leaves)`` with what hangs below, from ``(branch, up, saved, leaves)``.

    Each round adds to a branch what the branches 1, 2, 4, ... steps below it have gathered and doubles the step, so nested branches take as
    many rounds as their depth has binary digits.
    """
    state = durable(branches)
    while not state.where("up IS NOT NULL").isEmpty():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("branch")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = state.where("up IS NOT NULL").select(F.col("branch").alias("up"), F.col("up").alias("next"))
        added = state.join(given, "branch", "left").join(above, "up", "left")
        total = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")]
        state = durable(added.select("branch", F.col("next").alias("up"), *total))
    return state.select("branch", "saved", "leaves")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, *, block: int = BLOCK) -> Trie:
    """The trie of all distinct prefixes of conversations, from turns as :func:`number_turns` gives them.

    Blocks of ``block`` turns are grouped by the digest of all that stands before them and of themselves. A block that alone follows
    its prefix gives one node for each of its turns. Where sibling blocks diverge, their distinct blocks (not their conversations) are cut
    into turns and grouped again, which finds the turn at which they part. Prefixes are named by 128-bit sums over their turns' places.

    A node's members include all below it, so its smallest member is that of an unbroken run of nodes down one conversation: a branch. Sums over
    subtrees are added up over branches, then along each. Nothing is gathered by prefix: first turns that a
    third of all conversations share are counted in each task before they are moved, and a conversation with a third of all turns is summed in slices.

    ``conversations`` (``conv_id``) adds conversations without a turn, which end at the root. Without conversations there are no nodes.
    """
    ids = turns.select("conv_id") if conversations is None else turns.select("conv_id").union(conversations.select(F.col("conv_id").cast("long")))
    ids = ids.distinct()
    nodes = durable(_trie_nodes(turns, ids, block))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved, leaf = (F.col("n") - 1) * F.col("n_bytes"), (F.col("n_children") == 0).cast("long")
    known = durable(counted.join(parents, "parent", "left").withColumn("saved", saved).withColumn("leaves", leaf))
    top = ~F.col("conv_id").eqNullSafe(F.col("parent_conv_id"))
    branches = durable(
        known.groupBy(F.col("conv_id").alias("branch"))
        .agg(F.max(F.when(top, F.col("parent_conv_id"))).alias("up"), F.max(F.when(top, F.col("depth"))).alias("first"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    totals = _branch_totals(branches.select("branch", "up", "saved", "leaves"))
    hung = branches.where("up IS NOT NULL").select("branch", F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).join(totals, "branch")
    hung = hung.groupBy("conv_id", "depth").agg(F.sum("saved").alias("below_saved"), F.sum("leaves").alias("below_leaves"))
    here = known.join(hung, ["conv_id", "depth"], "left").withColumn("_up", -F.col("depth"))
    sums = {f"all_{c}": Running("sum", F.col(c) + F.coalesce(f"below_{c}", F.lit(0))) for c in ("saved", "leaves")}
    summed = running(here, ["conv_id"], ["_up"], sums, sizes=size_probe(known, ["conv_id"]))
    out = summed.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_bytes")
    )
    pieces = _pieces_of(F.col("no"), F.col("digest"))
    ended = turns.select("conv_id", *[p.alias(n) for n, p in zip(_PIECES, pieces, strict=True)]).groupBy("conv_id").agg(*[F.sum(p).alias(p) for p in _PIECES])
    ended = ended.select("conv_id", _named([F.col(p) for p in _PIECES]).alias("node"))
    ends = ids.join(ended, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"))
    return Trie(out, ends)


def grafted_turns(turns: DataFrame, *, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are taken from others, to make prefixes shared: ``(turns, conversations)``.

    Conversation ``c`` starts with the first ``h`` turns of conversation ``c - c % group`` (all if it has fewer, none if it is not there) and goes on
    with its own behind its first ``h``; ``h`` is crc32 of ``c`` in decimal, modulo ``heads``.
    """
    c = F.col("conv_id")
    drawn = F.crc32(c.cast("string").cast("binary")) % heads
    owners = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", (c - c % group).alias("owner"), drawn.cast("int").alias("h"))
    entry = F.struct("no", "digest", "n_bytes")
    starts = turns.where((F.col("no") < heads) & (c % group == 0)).groupBy(c.alias("owner")).agg(F.sort_array(F.collect_list(entry)).alias("start"))
    given = owners.join(starts, "owner", "left").select("conv_id", "h", F.when(F.col("start").isNotNull(), F.slice("start", F.lit(1), F.col("h"))).alias("start"))
    given = durable(given.withColumn("n", F.when(F.col("start").isNotNull(), F.size("start")).otherwise(0)))
    borrowed = given.select("conv_id", F.explode("start").alias("t")).select("conv_id", "t.no", "t.digest", "t.n_bytes")
    own = turns.join(given.select("conv_id", "h", "n"), "conv_id").where(F.col("no") > F.col("h"))
    own = own.select("conv_id", (F.col("no") - F.col("h") + F.col("n")).alias("no"), "digest", "n_bytes")
    return borrowed.union(own), given.select("conv_id")
