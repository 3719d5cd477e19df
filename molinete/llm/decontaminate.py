"""Benchmark decontamination by winnowing: the smallest k-gram hash of every window, joined, then extended to the shared spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.llm.common import durable, fresh, text_of
from molinete.llm.terms import terms_of
from molinete.operators.numbering import dense_ids

#: Words of a window; words of a k-gram. A window holds SPAN - GRAM + 1 k-grams, the smallest of which stands for it.
SPAN, GRAM = 10, 5
#: Bits of the filter in front of the join: 8 MB whatever the benchmark's size.
FILTER_BITS = 26
#: Words whose hashes a worker keeps; beyond that it starts anew.
CACHED = 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ROWS = "start int, length int, least bigint, window binary"


class _Hashes(dict):
    """Word -> 64 bits, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * _MIX[0] + _mixed(words[i : i + n])
    return _mixed(out)


def least_hashes(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every window of ``length`` words the smallest hash of its k-grams; equal windows have equal ones."""
    hashes = gram_hashes(words, min(gram, length))
    inside = length - min(gram, length) + 1
    if len(hashes) < inside:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - inside + 1].copy()
    for i in range(1, inside):
        np.minimum(out, hashes[i : i + len(out)], out=out)
    return out


def _window(words: list[bytes]) -> bytes:
    """128 bits of a window's words; no word holds a space."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def item_windows(items: DataFrame, *, span: int = SPAN, gram: int = GRAM, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, length, least, window)``: the windows of all items, each once; a null id is the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(batch.num_rows):
                words = terms_of(batch.column(1)[at].as_py())
                length = min(span, len(words))
                if not length:
                    continue
                least = least_hashes(hashes.of(words), length, gram).view(np.int64)
                n = len(least)
                windows = [_window(words[i : i + length]) for i in range(n)]
                name = pa.array([batch.column(0)[at].as_py()] * n, pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.full(n, length, np.int32)), pa.array(least), pa.array(windows, pa.binary())], ["item", "length", "least", "window"])

    rows = items.select(text_of(item_id).alias("item"), text_of(text).cast("binary").alias("body"))
    return rows.mapInArrow(work, "item string, length int, least bigint, window binary").distinct()


def fingerprint_filter(windows: DataFrame) -> np.ndarray:
    """A bit for each fingerprint's first ``FILTER_BITS`` bits: at most 2 ** 20 numbers come to the driver, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("least", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(least, {64 - FILTER_BITS}) & 63 AS INT))")
    words = windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words.toLocalIterator():
        out[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _passes(least: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = least >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))


@dataclass(frozen=True)
class Shared:
    """What documents share with a benchmark.

    ``documents``: ``(row, doc_id, n_words)``, one row per document. ``spans``: ``(row, start, end)``, the longest runs of words that
    windows cover, ``end`` not included. ``windows``: ``(row, start, length, window)``, every occurrence of an item's window.
    ``items``: ``(window, item)``.
    """

    documents: DataFrame
    spans: DataFrame
    windows: DataFrame
    items: DataFrame


def shared_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    span: int = SPAN,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    row: str | None = None,
) -> Shared:
    """Every run of at least ``span`` words that a document has in common with an item; a shorter item counts whole.

    Winnowing keeps the smallest hash of each window's k-grams as its fingerprint, on both sides. Equal windows have equal
    fingerprints, so every shared run of ``span`` words has one: none is missed. In one pass over the texts, fingerprints that a fixed
    8 MB filter of the benchmark's rules out go at once; the rest are joined with the benchmark's, and each hit is
    extended to the windows it stands for, which must agree in 128 bits of all their words. Overlapping windows make one span.

    The joins are by fingerprint and by window, distinct on the benchmark's side, so a passage that a third of the documents share costs a
    row for each of its places and never pairs. Null texts and texts without words have no spans. Rows that repeat an
    id (or have none) are documents of their own, and ``row`` tells them apart. Items without words, empty tables: no spans.
    ``row`` names a whole-number column of ``docs`` to use instead of numbers given here.
    """
    known = durable(item_windows(items, span=span, gram=gram, item_id=item_id, text=item_text))
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # at most ``span`` numbers
    bits = docs.sparkSession.sparkContext.broadcast(fingerprint_filter(known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kind = _Hashes(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("least", pa.int64()), ("window", pa.binary())]))
        for batch in batches:
            sizes, found = [], []
            for body in batch.column(2):
                words = terms_of(body.as_py())
                sizes.append(len(words))
                out = []
                values = hashes.of(words)
                for length in lengths:
                    least = least_hashes(values, length, gram)
                    places = _passes(least, bits.value)
                    for at, value in zip(places.tolist(), least[places].view(np.int64).tolist(), strict=True):
                        out.append((at, length, value, _window(words[at : at + length])))
                found.append([dict(zip(("start", "length", "least", "window"), x, strict=True)) for x in out])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["row", "doc_id", "n_words", "found"])

    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("bigint")
    rows = docs.select(number.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("body"))
    scanned = durable(rows.mapInArrow(scan, f"row bigint, doc_id bigint, n_words bigint, found array<struct<{', '.join(x.replace(' ', ': ') for x in _ROWS.split(', '))}>>"))
    candidates = scanned.select("row", F.inline("found"))
    fingerprints = known.select("least").distinct()
    hits = candidates.join(fingerprints, "least", "left_semi")
    windows = durable(hits.join(known.select("window").distinct(), "window", "left_semi").select("row", "start", "length", "window"))
    return Shared(scanned.select("row", "doc_id", "n_words"), _merged(windows), windows, known.select("window", "item"))


def _merged(windows: DataFrame) -> DataFrame:
    """``(row, start, end)``: the union of the windows of each row."""
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, 0)
    reach = windows.select("row", "start", "length", end.alias("end"), F.max(end).over(before).alias("reach"))
    marked = reach.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(upto))
    return marked.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _set_digest(member: Column, *, name: str) -> tuple[list[Column], Column]:
    """Aggregates of a set's distinct members, in any order and in parts, and 128 bits made of them."""
    pieces = [F.sum(F.conv(F.substring(F.md5(member.cast("binary")), 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"{name}_{i}") for i in range(4)]
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{name}_{i}") % (1 << 32))), 8, "0") for i in range(4)]).alias(name)
    return pieces, digest


def items_by_row(shared: Shared) -> tuple[DataFrame, DataFrame]:
    """``(row, items)`` and ``(items, item)``: each row's set of items by name of the set, and the members of each set, once.

    Windows with equal items are one class; a row's classes name its set. Documents with equal sets, a third of all rows perhaps, share one list,
    so lists are made for each distinct set and not for each document.
    """
    items = shared.items.distinct()
    pieces, digest = _set_digest(F.col("item"), name="class")
    classes = durable(items.groupBy("window").agg(*pieces).select("window", digest))
    seen = durable(shared.windows.select("row", "window").distinct().join(classes, "window").select("row", "class").distinct())
    pieces, digest = _set_digest(F.col("class"), name="items")
    sets = durable(seen.groupBy("row").agg(*pieces).select("row", digest))
    firsts = sets.groupBy("items").agg(F.min("row").alias("row"))
    members = classes.groupBy("class").agg(F.min("window").alias("window")).join(items, "window").select("class", "item")
    return sets, seen.join(firsts, "row").select("items", "class").join(members, "class").select("items", "item").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, *, span: int = SPAN, gram: int = GRAM, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no run of ``span`` words (and no shorter item whole) with an item; all columns."""
    (row,) = fresh(docs, "row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    shared = shared_spans(numbered, items, span=span, gram=gram, doc_id=doc_id, item_id=item_id, text=text, row=row)
    hit = shared.windows.select(F.col("row").alias(row)).distinct()
    return numbered.join(hit, row, "left_anti").select(*docs.columns)


def contamination_report(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_words, n_hit, items, contaminated)``, one row per document, and ``(items, no, name)``: the items of each set, numbered in the order of their names."""
    shared = shared_spans(docs, items)
    hit = shared.spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    sets, members = items_by_row(shared)
    names = dense_ids(shared.items.select("item").distinct(), ["item"], "no")
    lists = members.join(names, "item").select("items", "no", F.col("item").alias("name"))
    found = hit.join(sets, "row")
    report = shared.documents.join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return report.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", (n_hit > 0).alias("contaminated")), lists
