"""Exact BM25 top-k: inverted shards, written once; queries run over a shard side by side, frequent words as a matrix product, and every shard starts from the threshold of those before."""

from __future__ import annotations

import ctypes
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import suppress
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, text_of

#: Documents of a shard; words that may stand in its matrix, at most; one in so many documents holds each of them, at least.
SHARD, FREQUENT, ONE_IN = 4096, 640, 32
#: Bytes of a shard; queries that lie in one row, and in one partition, where shards and queries meet; words of the queries of a partition; terms
#: that are added up side by side in the end; queries that run side by side; shards that a task goes through, at most.
SHARD_BYTES, ROW_QUERIES, PART_QUERIES, PART_WORDS, TERMS, TOGETHER, SHARDS_OF_TASK = 48_000_000, 2048, 16_384, 8_000_000, 1 << 18, 128, 64
#: Products of a matrix that take as long as one entry of a list; kinds that queries of a row are sorted by; documents of a lane; entries of lists that are added up at a time.
LIST_COST, KINDS, LANE, PIECE = 300, 8, 16, 1 << 16
#: The unit roundoff of single precision.
_UNIT = 2.0**-24
#: A row of queries: their rows, ids and numbers of words; compressed, all their words once, each one's words by number, and weights.
BLOCK_OF = [
    pa.field(name, kind)
    for name, kind in (
        ("row", pa.list_(pa.int64())),
        ("query_id", pa.list_(pa.int64())),
        ("size", pa.list_(pa.int32())),
        ("words", pa.binary()),
        ("ids", pa.binary()),
        ("weights", pa.binary()),
    )
]


def squeeze(raw: bytes) -> bytes:
    """Zstandard, behind the length in four bytes."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(packed: bytes) -> bytes:
    return pa.decompress(packed[4:], decompressed_size=int.from_bytes(packed[:4], "little"), codec="zstd", asbytes=True)


def give_back() -> None:
    """Memory that was let go of and that the C library still holds goes back to the system, where it can do that."""
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.lower().split()


class Lists(NamedTuple):
    """The documents of a shard by their words: words by falling document frequency, and for each its documents in order and their times."""

    ids: np.ndarray
    nameless: np.ndarray
    lengths: np.ndarray
    words: list[bytes]
    spread: np.ndarray
    doc: np.ndarray
    times: np.ndarray

    def packed(self) -> list[bytes]:
        return [squeeze(b" ".join(x) if isinstance(x, list) else x.tobytes()) for x in self]

    @classmethod
    def of(cls, packed: list[bytes]) -> Lists:
        kinds = (np.int64, bool, np.int64, None, np.int32, np.int32, np.int32)
        return cls(*(unsqueeze(x).split() if kind is None else np.frombuffer(unsqueeze(x), kind) for x, kind in zip(packed, kinds, strict=True)))


class Postings:
    """Documents as they come in: the numbers of their words, one after the other, in compact arrays."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.word, self.lengths = array("i"), array("q")

    def add(self, name: int | None, text: bytes) -> None:
        words = words_of(text)
        self.ids.append(name)
        self.word.extend(map(self.number.__getitem__, words))
        self.lengths.append(len(words))

    def lists(self) -> Lists:
        """The documents by their words. Their words are let go on the way, so that no two forms of them are held together longer than it takes."""
        n, names = len(self.ids), list(self.number)
        self.number.clear()
        length = np.array(self.lengths, np.int64)
        key = np.frombuffer(self.word, np.int32).astype(np.int64) if len(self.word) else np.zeros(0, np.int64)
        self.word = array("i")
        key *= n
        key += np.repeat(np.arange(n, dtype=np.int32), length)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(key)).astype(np.int32)
        key = key[first]
        del first
        doc = (key % max(1, n)).astype(np.int32)
        key //= max(1, n)
        spread = np.bincount(key, minlength=len(names))
        del key
        by_spread = np.argsort(-spread, kind="stable")
        spot = runs((np.cumsum(spread) - spread)[by_spread], spread[by_spread])
        ids = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        words = list(map(names.__getitem__, by_spread.tolist()))
        return Lists(ids, np.array([i is None for i in self.ids], bool), length, words, spread[by_spread].astype(np.int32), doc[spot], times[spot])


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``, ``size[0]`` numbers, then those of the next."""
    ends = np.cumsum(size)
    spot = np.repeat(first - ends + size, size)
    spot += np.arange(len(spot))
    return spot


class Shard:
    """An inverted index of some documents, whose impacts are BM25 without the weight of the word."""

    def __init__(self, postings: Postings | Lists, mean_length: float, k1: float, b: float):
        own = postings.lists() if isinstance(postings, Postings) else postings
        self.ids, self.nameless, n = own.ids, own.nameless, len(own.ids)
        self.spread = own.spread.astype(np.int64)
        self.start = np.cumsum(self.spread) - self.spread
        # By document, for the final scores. Numbers of 16 bits are sorted by counting.
        order = np.argsort(own.doc.astype(np.uint16) if n <= 1 << 16 else own.doc, kind="stable")
        self.times = own.times.astype(np.min_scalar_type(own.times.max(initial=0)))[order]
        self.word = np.repeat(np.arange(len(own.words), dtype=np.int32), self.spread)[order]
        del order
        self.by_doc = np.concatenate([[0], np.cumsum(np.bincount(own.doc, minlength=n))])
        self.position = np.zeros(len(own.words), np.int32)
        # Document and impact of an entry side by side, so that one look-up gets both; impacts are in single precision.
        self.k1, self.scale = k1, k1 * (1 - b + b * own.lengths / max(mean_length, 1e-9))
        impact = own.times.astype(np.float32)
        below = self.scale.astype(np.float32)[own.doc]
        below += impact
        impact /= below
        impact *= np.float32(k1 + 1)
        del below
        self.entry = np.empty(len(own.doc), np.int64)
        self.entry.view(np.int32)[1::2] = own.doc
        self.impact = self.entry.view(np.float32)[::2]
        self.impact[:] = impact
        # Frequent words by document, a row each; rows are filled up to whole lanes.
        self.width = -(-n // LANE) * LANE
        many = min(FREQUENT, int(np.searchsorted(-self.spread, -n / ONE_IN, side="right")))
        top = int(self.spread[:many].sum())
        self.dense = np.zeros((many, self.width), np.float32)
        self.dense[np.repeat(np.arange(many), self.spread[:many]), own.doc[:top]] = impact[:top]
        del impact
        self.place = dict(zip(own.words, range(len(own.words)), strict=True))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, -1 where no document holds them."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def top(self, words: list[bytes], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`best` of a query whose words were not looked up."""
        return self.best(self.places(words), weights, k)

    def best(self, found: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the ``k`` best documents (more where scores tie) with a positive score, and their scores. ``found``: :meth:`places` of the words."""
        found = list(self.beating(found, weights, np.array([len(found)]), Tops(1, k)))
        return np.concatenate([np.zeros(0, np.int64), *(x for _, x, _ in found)]), np.concatenate([np.zeros(0), *(x for _, _, x in found)])

    def beating(self, found: np.ndarray, weights: np.ndarray, sizes: np.ndarray, tops: Tops) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries one after the other, ``(number, places, scores)`` of all documents that may be among the best with those of ``tops``, and a few
        that nearly are. ``found`` and ``weights`` are those of all queries, ``sizes`` words each.

        All documents are scored in single precision. What reaches the k-th best score, less what rounding can take from it, is scored in double
        precision. All terms are positive, so a sum of n of them is off by n + 8 roundings of itself at most: one in each addition, and in a term four of the impact and two more.
        """
        ends, k = np.cumsum(sizes), tops.k
        for i in range(0, len(sizes) if self.width else 0, TOGETHER):
            size = sizes[i : i + TOGETHER]
            begin = np.cumsum(size) - size
            own = slice(ends[i] - size[0], ends[i + len(size) - 1])
            words, weight = found[own], weights[own]
            rough, floor, room = self._rough(words, weight.astype(np.float32), size), tops.least()[i : i + TOGETHER], 1 - 2 * _UNIT * (size + 8)
            new = np.flatnonzero(np.isneginf(floor))
            if len(new):
                seen = rough[new]
                if self.width // LANE >= 4 * k:
                    seen = seen.reshape(len(new), LANE, -1).max(axis=1)  # the best of a lane are different documents
                floor[new] = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else 0
            reach = rough >= np.maximum(np.nextafter((floor * room).astype(np.float32), np.float32(-1)), np.float32(1e-45))[:, None]
            some = np.flatnonzero(reach.view(np.uint64))  # eight at a time
            which, at = np.nonzero(reach.reshape(-1, 8)[some])
            at += some[which] * 8
            query, place = np.divmod(at, self.width)
            bounds, some = np.searchsorted(query, np.arange(len(size) + 1)), []
            for j in np.flatnonzero(np.diff(bounds)).tolist():
                part = place[bounds[j] : bounds[j + 1]]
                had = -tops.below[i + j, : tops.size[i + j]]
                if len(part) + len(had) > k:  # the k-th best of both
                    score = rough[j, part]
                    part = part[score >= np.partition(np.concatenate([had, score]), -k)[-k] * room[j]]
                side = max(1, TERMS // max(1, int(size[j])))
                some += [(j, part[at : at + side]) for at in range(0, len(part), side)]
            terms = np.cumsum([len(part) * size[j] for j, part in some]) // TERMS
            for same in np.split(np.arange(len(some)), np.flatnonzero(np.diff(terms)) + 1):
                group = [some[at] for at in same.tolist()]
                for (j, part), score in zip(group, self._scores(group, words, weight, begin, size) if group else (), strict=True):
                    yield i + j, part, score

    def _rough(self, found: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The scores of all documents in single precision, a row a query."""
        queries, n = len(sizes), len(self.ids)
        query, known = np.repeat(np.arange(queries), sizes), found >= 0
        query, found, weights = query[known], found[known], weights[known]
        # Words that so many of these queries and documents hold that their lists, query by query, would take longer than a matrix product.
        many = len(self.dense)
        held = np.bincount(found[found < many], minlength=many)
        chosen = np.flatnonzero(held * self.spread[:many] * LIST_COST > queries * n)
        column = np.full(many + 1, -1, np.int64)
        column[chosen] = np.arange(len(chosen))
        at = column[np.minimum(found, many)]
        dense = at >= 0
        asked = np.zeros((queries, len(chosen)), np.float32)
        asked[query[dense], at[dense]] = weights[dense]
        out = asked @ self.dense[chosen]
        rest = ~dense
        query, found, weights = query[rest], found[rest], weights[rest]
        first, size = self.start[found], self.spread[found]
        ends = np.concatenate([[0], np.cumsum(size)])
        # The lists of a query go in pieces of PIECE entries or so, whatever its length.
        piece = (ends[:-1] - ends[np.searchsorted(query, query)]) // PIECE
        bounds = np.concatenate([[0], np.flatnonzero((query[1:] != query[:-1]) | (piece[1:] != piece[:-1])) + 1, [len(query)]])
        longest = int(np.diff(ends[bounds]).max(initial=0))
        base, count = first - ends[:-1], np.arange(longest)
        entry, term, place = np.empty(longest, np.int64), np.empty(longest, np.float32), np.empty(longest, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            row, times, m = out[query[a]], size[a:b], ends[b] - ends[a]
            spot = np.repeat(base[a:b] + ends[a], times)
            spot += count[:m]
            self.entry.take(spot, out=entry[:m], mode="clip")
            np.multiply(entry[:m].view(np.float32)[::2], np.repeat(weights[a:b], times), out=term[:m])
            np.right_shift(entry[:m], 32, out=place[:m])
            np.add.at(row, place[:m], term[:m])
        return out

    def _scores(self, some: list[tuple[int, np.ndarray]], found: np.ndarray, weights: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Scores in double precision, summed in the order of the query's words, so that equal texts tie in every shard. ``some``: queries and places; ``begin``, ``sizes``: where a query's words are."""
        spots, ats = [], []
        for j, places in some:
            each = found[begin[j] : begin[j] + sizes[j]]
            known = np.flatnonzero(each >= 0)
            self.position[each[known]] = known + 1
            for a, b in zip(self.by_doc[places].tolist(), self.by_doc[places + 1].tolist(), strict=True):
                at = self.position.take(self.word[a:b])
                spot = at.nonzero()[0]
                ats.append(at[spot])
                spots.append(spot)
            self.position[each[known]] = 0
        places, hits = np.concatenate([x for _, x in some]), np.array(list(map(len, spots)))
        query = np.repeat([j for j, _ in some], [len(x) for _, x in some])
        row, at, spot = np.repeat(np.arange(len(places)), hits), np.concatenate(ats), np.concatenate(spots)
        at -= 1
        spot += self.by_doc[places][row]
        times, ends = self.times[spot], np.cumsum(sizes[query])
        terms = np.zeros(ends[-1])
        terms[(ends - sizes[query])[row] + at] = times * (self.k1 + 1) / (times + self.scale[places][row]) * weights[begin[query][row] + at]
        cuts = [0, *ends[np.cumsum([len(x) for _, x in some]) - 1].tolist()]
        return [terms[a:b].reshape(len(x), -1).sum(axis=1) for a, b, (_, x) in zip(cuts, cuts[1:], some, strict=False)]


class Tops:
    """The best documents so far of the queries of a row."""

    def __init__(self, queries: int, k: int):
        self.k, self.below = k, np.full((queries, k), np.inf)
        self.nameless, self.ids, self.size = np.zeros((queries, k), bool), np.zeros((queries, k), np.int64), np.zeros(queries, np.int64)

    def least(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity where there are fewer."""
        return -self.below[:, -1]

    def take(self, query: int, scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        had = self.size[query]
        rows = [np.concatenate([old[query, :had], new]) for old, new in ((self.below, -scores), (self.nameless, nameless), (self.ids, ids))]
        order = np.lexsort(rows[::-1])[: self.k]
        self.size[query] = len(order)
        for kept, row in zip((self.below, self.nameless, self.ids), rows, strict=True):
            kept[query, : len(order)] = row[order]


def by_kind(number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order of queries that has those of frequent words in common side by side; ``number``: their words, ``sizes`` each."""
    query, held = np.repeat(np.arange(len(sizes)), sizes), np.bincount(number)
    top = np.argsort(-held, kind="stable")[: KINDS * 32]
    column = np.full(len(held), -1)
    column[top] = np.arange(len(top))
    at = column[number]
    marks = np.zeros((len(sizes), len(top)), np.float32)
    marks[query[at >= 0], at[at >= 0]] = 1
    marks *= np.log1p(len(sizes) / held[top]).astype(np.float32)
    marks /= np.maximum(np.linalg.norm(marks, axis=1, keepdims=True), 1e-9)
    center = marks[np.linspace(0, len(sizes) - 1, KINDS).astype(int)]
    for _ in range(5):
        kind = np.argmax(marks @ center.T, axis=1)
        center = np.stack([marks[kind == i].sum(axis=0) for i in range(KINDS)])
        center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-9)
    return np.argsort(kind, kind="stable")


def statistics(indexed: DataFrame) -> tuple[DataFrame, int, float]:
    """``(word, n)``, the number of documents that hold a word, from the lists of all shards; the number of documents and their mean length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, spread, lengths = map(unsqueeze, index)
                length = np.frombuffer(lengths, np.int64)
                words = [b" ", b"  ", *words.split()]  # no word holds a space
                n = np.concatenate([[len(length), length.sum()], np.frombuffer(spread, np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    spread = durable(indexed.select("index.words", "index.spread", "index.lengths").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    sums = {bytes(r["word"]): r["n"] for r in spread.where(F.col("word").isin(bytearray(b" "), bytearray(b"  "))).collect()}
    n, length = sums.get(b" ", 0), sums.get(b"  ", 0)
    return spread, n, length / max(1, n)


def weighted_queries(spread: DataFrame, n: int, queries: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """``(row, query_id, words, weights)``, the words joined by spaces and the weights as 64-bit floats; ``spread``, ``n``: :func:`statistics` of all documents."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(w) for w in batch.column(1).to_pylist()]
            weights = [np.array(w, "<f8").tobytes() for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(words, pa.binary()), pa.array(weights, pa.binary())], ["row", "query_id", "words", "weights"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(b)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                ["row", "query_id", "words", "times"],
            )

    rows = queries.select(F.monotonically_increasing_id().alias("row"), text_of(text).cast("binary").alias("body"), F.col(doc_id).cast("long").alias("query_id"))
    each = rows.mapInArrow(terms, "row bigint, query_id bigint, words array<binary>, times array<int>").select("row", "query_id", F.explode(F.arrays_zip("words", "times")).alias("t"))
    idf = F.log1p((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    named = each.select("row", "query_id", F.col("t.words").alias("word"), F.col("t.times").alias("times")).join(spread, "word")
    grouped = named.groupBy("row").agg(F.first("query_id").alias("query_id"), F.sort_array(F.collect_list(F.struct("word", (F.col("times") * idf).alias("weight")))).alias("t"))
    rows = grouped.select("row", F.col("t.word").alias("words"), F.col("t.weight").alias("weights"), "query_id")
    return durable(rows.mapInArrow(packed, "row bigint, query_id bigint, words binary, weights binary"))


def top_documents(
    docs: DataFrame, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: for each row of ``queries`` its ``k`` best documents by BM25, ties by smaller id.

    Statistics are those of all documents. Documents are dealt to shards of about ``shard`` rows (and ``SHARD_BYTES``) by hash of their
    id and text; each shard's lists are made once and written. Queries lie in parts of about ``PART_QUERIES``. A task takes up to
    ``SHARDS_OF_TASK`` shards one after the other and meets every query of a part with each, reading both from where they were written once: what is
    written grows with documents and queries, not with their product. Its memory holds one shard, one row of queries and the part's best documents so far;
    the k-th best of those is what a document of the next shard must reach. Every
    task returns its exact top k, and the best k of those are the best of all. A word's weight is its times in the query times
    ``ln(1 + (N - n + 0.5) / (n + 0.5))``.

    Null texts are empty. A document needs a word of the query, so a query may have fewer than ``k`` rows and one without words
    none. Rows that repeat an id are documents (or queries) of their own; null ids come last among ties. Empty tables give no rows.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_of(text))), F.lit(0))).first()
    shards = max(1, -(-n // shard), -(-size // SHARD_BYTES))

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = pa.array([squeeze(b.as_py()) for b in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], ["shard", "id", "body"])

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column("shard").to_pylist()):
                own, postings = batch.column("docs")[i].values, Postings()
                for name, body in zip(own.field("id").to_pylist(), own.field("body"), strict=True):
                    postings.add(name, unsqueeze(body.as_py()))
                lists, postings, own = postings.lists(), None, None
                index, lists = pa.StructArray.from_arrays([pa.array([x], pa.binary()) for x in lists.packed()], Lists._fields), None
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), index], ["shard", "index"])

    # A shard is one row where it is gathered, so its texts are compressed. Its number is its partition, so the
    # gathering that follows needs no further shuffle.
    indexed = durable(
        docs.select(
            F.pmod(F.xxhash64(F.col(doc_id), text_of(text)), F.lit(shards)).cast("int").alias("shard"),
            F.col(doc_id).cast("long").alias("id"),
            text_of(text).cast("binary").alias("body"),
        )
        .mapInArrow(squeezed, "shard int, id bigint, body binary")
        .select("shard", F.struct("id", "body").alias("doc"))
        .repartitionById(shards, "shard")
        .groupBy("shard")
        .agg(F.collect_list("doc").alias("docs"))
        .mapInArrow(inverted, f"shard int, index struct<{', '.join(f'{x}: binary' for x in Lists._fields)}>")
    )
    spread, n, mean_length = statistics(indexed)
    weighted = weighted_queries(spread, n, queries, doc_id=doc_id, text=text)
    asked, terms = weighted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("weights") / 8), F.lit(0))).first()
    parts = max(1, -(-asked // PART_QUERIES), -(-int(terms) // PART_WORDS))
    rows = parts * max(1, -(-asked // (parts * ROW_QUERIES)))
    tasks = max(1, min(shards, max(-(-2 * docs.sparkSession.sparkContext.defaultParallelism // parts), -(-shards // SHARDS_OF_TASK))))

    def block_of(block: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        each = [np.fromiter((number.setdefault(w, len(number)) for w in q.split(b" ")), "<i4") for q in block.column("words").to_pylist()]
        order = by_kind(np.concatenate(each), np.array([len(q) for q in each]))
        each, block = [each[i] for i in order.tolist()], block.take(order)
        long = [squeeze(x) for x in (b" ".join(number), np.concatenate(each).tobytes(), b"".join(block.column("weights").to_pylist()))]
        columns = [block.column("row").to_pylist(), block.column("query_id").to_pylist(), [len(q) for q in each], *long]
        found = pa.StructArray.from_arrays([pa.array([c], f.type) for c, f in zip(columns, BLOCK_OF, strict=True)], fields=BLOCK_OF)
        return pa.table({"block": block.column("block")[:1], "queries": found})

    # Words are numbered within a row of queries, so that a shard looks each of them up once.
    blocks = (
        weighted.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(rows)).cast("int"))
        .groupBy("block")
        .applyInArrow(block_of, "block int, queries struct<row:array<bigint>,query_id:array<bigint>,size:array<int>,words:binary,ids:binary,weights:binary>")
        .select((F.col("block") % parts).alias("part"), F.lit(1).alias("kind"), "queries")
    )
    # Every part has a row without queries, and a shard's documents come along with that row alone. Rows of a part are in no order.
    opening = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(blocks.schema["queries"].dataType).alias("queries"))
    dealt = blocks.union(opening).repartitionByRange(parts, "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, waiting, tops = None, None, [], {}
        for batch in batches:
            for i, part in enumerate(batch.column("shard").to_pylist()):
                own, asked = batch.column("index")[i], batch.column("queries")[i]
                if part != now:
                    now, index, waiting = part, None, []
                if own.is_valid and index is None:
                    give_back()
                    index = Shard(Lists.of([own[c].as_py() for c in Lists._fields]), mean_length, k1, b)
                    give_back()
                if asked.is_valid:
                    waiting.append(asked)
                while index is not None and waiting:
                    answer(index, waiting.pop(), tops)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        for names, best in tops.values():
            out = [(now, *name, best.below[i, :m], best.nameless[i, :m], best.ids[i, :m]) for i, (name, m) in enumerate(zip(names, best.size.tolist(), strict=True)) if m]
            if out:
                arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "row", "query_id", "below", "nameless", "doc_id"])

    def answer(index: Shard, asked: pa.StructScalar, tops: dict[int, tuple[list[tuple[int, int]], Tops]]) -> None:
        rows, names, sizes = (asked[c].as_py() for c in ("row", "query_id", "size"))
        words, ids, weights = (unsqueeze(asked[c].as_py()) for c in ("words", "ids", "weights"))
        found = index.places(words.split(b" "))[np.frombuffer(ids, "<i4")]
        if rows[0] not in tops:
            tops[rows[0]] = (list(zip(rows, names, strict=True)), Tops(len(rows), k))
        best = tops[rows[0]][1]
        for i, place, score in index.beating(found, np.frombuffer(weights, "<f8"), np.array(sizes), best):
            best.take(i, score, index.nameless[place], index.ids[place])

    met = indexed.coalesce(tasks).crossJoin(dealt.hint("shuffle_replicate_nl")).select("shard", F.when(F.col("kind") == 0, F.col("index")).alias("index"), "queries")
    found = met.mapInArrow(search, "shard int, row bigint, query_id bigint, below array<double>, nameless array<boolean>, doc_id array<bigint>")
    tops = found.select("row", "query_id", (F.col("shard") % 64).alias("part"), F.arrays_zip("below", "nameless", "doc_id").alias("top"))
    # The best of a part of the shards, then of the parts: no group holds more than k rows of each of its members.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    merged = tops.groupBy("row", "part").agg(F.first("query_id").alias("query_id"), best).groupBy("row").agg(F.first("query_id").alias("query_id"), best)
    return merged.select("query_id", F.posexplode("top").alias("place", "t")).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.when(~F.col("t.nameless"), F.col("t.doc_id")).alias("doc_id"),
        (-F.col("t.below")).alias("score"),
    )
