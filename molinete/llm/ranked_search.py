"""Exact ranked search over impact vectors in buckets of falling length, pruned by Cauchy-Schwarz and by coordinates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molinete.llm.common import durable, running_before, text_of
from molinete.llm.terms import terms_of

#: Distinct terms of a block of items (and those of one item more): bounds what a block broadcasts.
BLOCK_TERMS = 65_536
#: Vectors of a bucket; coordinates of an item that are read before a vector is kept or dropped.
BUCKET, FOCUS = 1024, 8
#: The scale of an impact, and of a term's weight (fixed values of the ranking).
IMPACT, WEIGHT = 1_000_000_000, 1000

_INDEX = "doc_id bigint, n bigint, at binary, times binary"


class Block:
    """Some items and the terms they use: ``rows`` their numbers, ``asked`` for each its terms' places and times."""

    def __init__(self, items: list[tuple[int, list[bytes], list[int]]]):
        self.rows = [row for row, _, _ in items]
        self.place: dict[bytes, int] = {}
        self.asked = [(np.array([self.place.setdefault(t, len(self.place)) for t in terms], np.int32), np.array(times, np.int64)) for _, terms, times in items]


def term_counts(texts: DataFrame) -> DataFrame:
    """``(row, terms, times, size)`` of ``(row, body)``: the distinct terms of each text, their times, their number; texts without a term are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, Counter(terms_of(body))) for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(row, c) for row, c in found if c]
            columns = [pa.array([r for r, _ in found], pa.int64()), pa.array([list(c) for _, c in found], pa.list_(pa.binary()))]
            columns += [pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64())), pa.array([len(c) for _, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "terms", "times", "size"])

    return texts.mapInArrow(work, "row bigint, terms array<binary>, times array<bigint>, size bigint")


def blocks_of(items: DataFrame, terms: int) -> tuple[DataFrame, int]:
    """``items`` (of :func:`term_counts`) with their ``block``: consecutive items of at most ``terms`` terms and one item more; the number of blocks."""
    sliced = items.withColumn("all", F.lit(0))
    placed = running_before(sliced, ["all"], ["row"], F.pmod(F.xxhash64("row"), F.lit(64)).cast("int"), "size", "before")
    numbered = durable(placed.select("row", "terms", "times", F.floor(F.col("before") / terms).cast("int").alias("block")))
    last = numbered.agg(F.max("block")).first()[0]
    return numbered, 0 if last is None else last + 1


def block_vectors(docs: DataFrame, block: Broadcast) -> DataFrame:
    """``(doc_id, n, at, times)`` of ``(doc_id, body)``: documents with a term, their number of terms, and the places and times of the block's among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = block.value.place
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                counts = Counter(terms_of(batch.column(1)[i].as_py()))
                if counts:
                    used = [(place[t], c) for t, c in counts.items() if t in place]
                    at, times = zip(*used, strict=True) if used else ((), ())
                    out.append((batch.column(0)[i].as_py(), sum(counts.values()), np.array(at, "<i4").tobytes(), np.array(times, "<i8").tobytes()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "at", "times"])

    return docs.mapInArrow(work, _INDEX)


def holders(vectors: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs; every task sends its own sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for at in batch.column(0):
                total[np.frombuffer(at.as_py(), "<i4")] += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in vectors.select("at").mapInArrow(work, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def impacts(times: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """What each term adds for a unit of its weight: whole numbers, rounded down."""
    m = 100 - 25 + (25 * int(n) * documents) // length
    return IMPACT * times // (1000 * times + 12 * m)


class Corpus:
    """What scores need of all documents: their number, their length in terms, and each term's weight."""

    def __init__(self, block: Block, documents: int, length: int, df: np.ndarray):
        self.documents, self.length = documents, length
        self.weight = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        # Both sides carry the root of the weight, so that neither a frequent term's impact nor a rare one's weight decides a length alone.
        self.root = np.sqrt(self.weight.astype(np.float64))
        self.asked = []
        for at, times in block.asked:
            exact, vector = self.weight[at] * times, self.root[at] * times
            order = np.argsort(-vector, kind="stable")
            at, exact, vector = at[order], exact[order], vector[order]
            rest = np.sqrt(max(0.0, float((vector[FOCUS:] ** 2).sum())))
            self.asked.append((at, exact, vector, float(np.sqrt((vector**2).sum())), rest))

    def norm(self, at: np.ndarray, times: np.ndarray, n: int) -> float:
        return float(np.sqrt(((self.root[at] * impacts(times, n, self.documents, self.length)) ** 2).sum()))


class Bucket:
    """Vectors of similar length: by vector for exact scores, by coordinate for bounds."""

    def __init__(self, rows: list[tuple[int | None, int, bytes, bytes, float]], corpus: Corpus):
        self.nameless = np.array([r[0] is None for r in rows], bool)
        self.ids = np.array([np.iinfo(np.int64).max if r[0] is None else r[0] for r in rows], np.int64)
        at, times = [np.frombuffer(r[2], "<i4") for r in rows], [np.frombuffer(r[3], "<i8") for r in rows]
        self.norm = np.array([r[4] for r in rows])
        self.sizes = np.array([len(a) for a in at], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.at = np.concatenate(at) if at else np.zeros(0, np.int32)
        self.impact = np.concatenate([impacts(t, r[1], corpus.documents, corpus.length) for t, r in zip(times, rows, strict=True)]) if rows else np.zeros(0, np.int64)
        sort = np.argsort(self.at, kind="stable")
        self.doc = np.repeat(np.arange(len(rows)), self.sizes)[sort]
        self.value = self.impact[sort] * corpus.root[self.at[sort]]
        self.term = self.at[sort]
        self.longest = float(self.norm.max()) if rows else 0.0
        self._exact = np.zeros(len(corpus.weight), np.int64)

    def survivors(self, query: tuple, threshold: int) -> np.ndarray:
        """Vectors whose score may reach ``threshold``.

        A query's largest coordinates are read from the bucket's lists: a vector's score is at most what they give and the product of
        what is left of both lengths. A vector that has none of them is bounded by its length and the rest of the query's.
        """
        at, _, vector, _, rest = query
        head = at[:FOCUS]
        first, last = np.searchsorted(self.term, head), np.searchsorted(self.term, head, side="right")
        got, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for a, b, q in zip(first.tolist(), last.tolist(), vector[:FOCUS].tolist(), strict=True):
            docs, value = self.doc[a:b], self.value[a:b]
            got[docs] += q * value
            squares[docs] += value * value
        left = np.sqrt(np.maximum(0.0, self.norm * self.norm * (1 + 1e-12) - squares))
        return np.flatnonzero((got + rest * left) * (1 + 1e-9) + 1 >= threshold)

    def scores(self, query: tuple, places: np.ndarray) -> np.ndarray:
        """Exact scores, in whole numbers."""
        at, exact, *_ = query
        self._exact[at] = exact
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        spot = np.repeat(self.start[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        each = np.concatenate([[0], np.cumsum(self._exact[self.at[spot]] * self.impact[spot])])
        self._exact[at] = 0
        return each[ends] - each[ends - sizes]


class Best:
    """The best ``k`` of one item so far: higher score first, then the smaller id, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.ids, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A score below this is not among the best."""
        return max(self.floor, 1, int(self.score[-1]) if len(self.score) == self.k else 1)

    def add(self, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        keep = score >= self.threshold
        score, ids, nameless = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.ids, ids), (self.nameless, nameless)))
        order = np.lexsort((ids, nameless, -score))[: self.k]
        self.score, self.ids, self.nameless = score[order], ids[order], nameless[order]


def _searched(found: list[Best], rows: list[int], seen: tuple[int, int, int]) -> pa.RecordBatch:
    out = [(row, int(s), None if none else int(i)) for row, b in zip(rows, found, strict=True) for s, i, none in zip(b.score, b.ids, b.nameless, strict=True)]
    out += [(-1 - i, n, None) for i, n in enumerate(seen)]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["row", "score", "doc_id"])


def search_buckets(vectors: DataFrame, block: Broadcast, corpus: Broadcast, floors: Broadcast | None, k: int, bucket: int) -> DataFrame:
    """``(row, score, doc_id)``: each task's best for every item of the block; rows below zero count pairs met, pairs left after the length bound, and pairs scored.

    A task reads its vectors by falling length, a bucket at a time. For an item whose length times the bucket's longest stays below the
    item's threshold, the bucket and all behind it are skipped. Without ``floors`` only the first bucket of each task is read: its true scores
    give the thresholds that all tasks then start from.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rows = corpus.value.asked, block.value.rows
        best = [Best(k, 1 if floors is None else floors.value[i]) for i in range(len(rows))]
        open_, waiting, met, left, scored = list(range(len(rows))), [], 0, 0, 0

        def search() -> None:
            nonlocal open_, met, left, scored
            now = Bucket(waiting[:bucket], corpus.value)
            del waiting[:bucket]
            met += len(rows) * len(now.ids)
            open_ = [i for i in open_ if asked[i][3] * now.longest * (1 + 1e-9) + 1 >= best[i].threshold]
            for i in open_:
                places = now.survivors(asked[i], best[i].threshold)
                left, scored = left + len(now.ids), scored + len(places)
                if len(places):
                    best[i].add(now.scores(asked[i], places), now.ids[places], now.nameless[places])

        for batch in batches:
            if floors is None and met:
                continue
            waiting.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(waiting) >= bucket and not (floors is None and met):
                search()
        if waiting and not (floors is None and met):
            search()
        yield _searched(best, rows, (met, left, scored))

    return vectors.select("doc_id", "n", "at", "times", "norm").mapInArrow(work, "row bigint, score bigint, doc_id bigint")


def _search_block(spark: SparkSession, docs: DataFrame, items: list[tuple[int, list[bytes], list[int]]], k: int, bucket: int) -> DataFrame:
    here = Block(items)
    block = spark.sparkContext.broadcast(here)
    counted = durable(block_vectors(docs, block))
    totals = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    known = Corpus(here, totals["documents"], totals["length"] or 0, holders(counted, len(here.place)))
    corpus = spark.sparkContext.broadcast(known)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "at", "times")), strict=True)
            norms = [corpus.value.norm(np.frombuffer(at, "<i4"), np.frombuffer(times, "<i8"), n) for n, at, times in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64())], [*batch.schema.names, "norm"])

    # Vectors of equal length (copies) are dealt on by a hash, so that a group of them does not fill one task.
    lengths = counted.where(F.length("at") > 0).mapInArrow(measured, f"{_INDEX}, norm double").where("norm > 0").withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    vectors = durable(lengths.repartitionByRange(F.col("norm").desc(), "deal").sortWithinPartitions(F.col("norm").desc(), "deal"))
    found = search_buckets(_by_length(vectors), block, corpus, None, k, bucket).where("row >= 0")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc()))
    reached = {r["row"]: r["score"] for r in found.select("row", "score", place.alias("place")).where(F.col("place") == k).collect()}
    floors = spark.sparkContext.broadcast([reached.get(row, 1) for row in here.rows])
    return search_buckets(_by_length(vectors), block, corpus, floors, k, bucket)


def _by_length(vectors: DataFrame) -> DataFrame:
    """Read back in whatever parts, the vectors of a part are in order again."""
    return vectors.sortWithinPartitions(F.col("norm").desc(), "deal")


def ranked_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 20, block_terms: int = BLOCK_TERMS, bucket: int = BUCKET, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text"
) -> DataFrame:
    """``(row, item_id, rank, doc_id, score)``: for every row of ``items`` its ``k`` documents of highest score above 0, ties by smaller id.

    Items are taken in blocks of a bounded number of terms. For a block, one pass over the texts makes each document's
    vector over the block's terms. Lengths of the vectors deal them to ranges, longest first, and each range to buckets. The longest
    bucket of every range is searched first; the k-th best of its scores is where all thresholds start. A bucket is skipped when its
    longest vector's length times the item's cannot reach the threshold; inside, the item's largest coordinates and the lengths of what is left
    bound each vector; what may reach the threshold is scored exactly in 64-bit whole numbers.

    Null texts, and texts without a term, are no documents and no items. Rows that repeat an id are documents (or items) of their own;
    null ids come last among ties. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    numbered = durable(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), text_of(item_text).cast("binary").alias("body")))
    terms, blocks = blocks_of(term_counts(numbered.select("row", "body")), block_terms)
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("body"))
    found = None
    for number in range(blocks):  # block_terms bounds what comes to the driver
        rows = [(r["row"], [bytes(t) for t in r["terms"]], r["times"]) for r in terms.where(F.col("block") == number).orderBy("row").collect()]
        part = _search_block(spark, bodies, rows, k, bucket).where("row >= 0")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "row bigint, score bigint, doc_id bigint")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(numbered.select("row", "item_id"), "row").select("row", "item_id", "rank", "doc_id", "score")
