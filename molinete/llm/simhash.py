"""Near copies by SimHash: fingerprints, links within a few bits through the pigeonring filter, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, fresh, text_of
from molinete.operators.components import components

#: Buckets of up to so many fingerprints compare all their pairs; larger ones go by shared one-bit neighbours.
BUCKET = 64

_LANES = np.uint64(0x0101010101010101)


def _votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes that begins at ``starts``: how often each of the 64 bits is set, lowest first."""
    lengths = np.diff(np.append(starts, len(hashes)))
    # Byte lanes hold sums of up to 255 rows.
    blocks = (lengths + 254) // 255
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    inside = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    block_starts = np.repeat(starts, blocks) + 255 * inside
    out = np.zeros((len(starts), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, block_starts)
        out[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
    return out.reshape(-1, 64)


def fingerprints(texts: list[bytes], words_per_shingle: int = 3) -> np.ndarray:
    """64 bits per text: a bit is set where over half of its shingles' XXH64 (seed 42) have it set; no words: zero."""
    import xxhash

    digest, n = partial(xxhash.xxh64_intdigest, seed=42), words_per_shingle
    parts, lengths = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) >= n:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
            parts.append(np.fromiter(map(digest, shingles), np.uint64, len(words) - n + 1))
        else:
            parts.append(np.array([digest(b" ".join(words))] if words else [0], np.uint64))
        lengths.append(len(parts[-1]))
    if not parts:
        return np.zeros(0, np.uint64)
    lengths = np.array(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    votes = _votes(np.concatenate(parts), starts)
    return np.packbits(2 * votes > lengths[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def document_fingerprints(docs: DataFrame, *, words_per_shingle: int = 3, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``(doc_id, bits, row)``: each text's fingerprint as a signed long, and the value of a column ``row`` (null without one)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = fingerprints(part.column(1).to_pylist(), words_per_shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(2)], ["doc_id", "bits", "row"])

    own = F.lit(None) if row is None else F.col(row)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("body"), own.cast("long").alias("row"))
    return rows.mapInArrow(work, "doc_id bigint, bits bigint, row bigint")


def _segment(bits: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1))


#: Three segments on a ring of 64 bits (lowest bit, width), each in two halves.
_RING = ((0, 22), (22, 21), (43, 21))


def near_links(prints: DataFrame, *, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (``bits``) at up to two differing bits, complete up to connectivity.

    Pigeonring with three segments and a budget of two: of two linked fingerprints some segment is equal (2/3 bits allowed),
    and it and the next on the ring differ in at most one bit together (4/3 allowed). So one half of that next segment is equal too:
    a segment with half of its successor is the key, about 32 bits, six keys a fingerprint. What shares a key is pruned by
    the chain of two, then checked over all 64 bits.

    A bucket of more than ``bucket`` fingerprints emits no pairs. Its members list their 65 neighbours at up to
    one bit instead; two fingerprints are linked just if they share one, so members of each neighbour are tied to its
    smallest. That is exact and linear in the bucket, whatever its size.
    """
    if max_bits != 2:
        raise ValueError("the ring is laid out for a budget of two bits")
    bits = F.col("bits")
    keys = []
    for place, (low, width) in enumerate(_RING):
        next_low, next_width = _RING[(place + 1) % 3]
        half = next_width // 2
        for part, (at, size) in enumerate(((next_low, half), (next_low + half, next_width - half))):
            joined = F.shiftleft(_segment(bits, low, width), 32).bitwiseOR(F.shiftleft(_segment(bits, at, size), 4))
            keys.append(F.struct(F.lit(place).alias("place"), joined.bitwiseOR(F.lit(2 * place + part)).alias("key")))
    keyed = durable(prints.select("bits", F.explode(F.array(*keys)).alias("k")).select("bits", "k.place", "k.key"))
    sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = durable(keyed.join(sizes, "key"))

    pair = shared.where(F.col("n") <= bucket)
    left, right = pair.select("key", "place", F.col("bits").alias("a")), pair.select("key", F.col("bits").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for place, (low, width) in enumerate(_RING):
        next_low, next_width = _RING[(place + 1) % 3]
        two = F.bit_count(_segment(differ, low, width)) + F.bit_count(_segment(differ, next_low, next_width))
        chain = chain | ((F.col("place") == place) & (two <= 1))
    met = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & chain & (F.bit_count(differ) <= max_bits))
    pairs = met.select("a", "b")

    crowded = shared.where(F.col("n") > bucket).select("bits").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = durable(crowded.select(F.col("bits").alias("a"), F.explode(flips).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("near")))
    least = durable(near.groupBy("near").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    tied = near.join(least, "near").where("a <> b").select("a", "b")
    return pairs.union(tied).distinct()


def near_groups(docs: DataFrame, *, words_per_shingle: int = 3, max_bits: int = 2, bucket: int = BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: 16 hex digits, and the smallest id reachable over links.

    Equal fingerprints are one node, so copies of one text cost one row however many there are. Null texts are empty; texts
    without words share the zero fingerprint and are linked like any others. Null ids get a fingerprint and their group's
    smallest id (null if it has none). Rows that repeat an id each get a row. An empty table gives no rows.
    """
    groups = _rooted(document_fingerprints(docs, words_per_shingle=words_per_shingle, doc_id=doc_id, text=text), max_bits, bucket)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """``prints`` with the ``root`` of each one's group and the group's smallest id, ``component_id``."""
    prints = durable(prints)
    nodes = durable(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    rooted = components(near_links(nodes, max_bits=max_bits, bucket=bucket))
    placed = nodes.join(rooted, nodes["bits"] == rooted["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    placed = durable(placed)
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(placed.join(lowest, "root").select("bits", "root", "component_id"))
    return prints.join(named, "bits")


def drop_near_copies(docs: DataFrame, *, words_per_shingle: int = 3, max_bits: int = 2, bucket: int = BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns: that with the smallest id, null ids last; of rows that repeat it one stays.

    Rows are told apart by a number that is written with them, not by their ids.
    """
    (row,) = fresh(docs, "row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = durable(_rooted(document_fingerprints(numbered, words_per_shingle=words_per_shingle, doc_id=doc_id, text=text, row=row), max_bits, bucket).select("root", "doc_id", "bits", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "bits", "row"))
    kept = groups.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    dropped = groups.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row))
    return numbered.join(durable(dropped), row, "left_anti").drop(row)
