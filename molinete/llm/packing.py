"""Packing token sequences: exact complements by length under availability counts, then best fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, running_before, text_of

#: Words whose ids a worker keeps; beyond that it starts its cache anew.
CACHED_WORDS = 400_000
#: Parts into which the pieces of one length are dealt to be numbered.
SLICES = 256


#: ASCII signs that group into one pre-token when they stand in a row (the apostrophe has rules of its own).
_SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _letters(word: bytes) -> bool:
    """Whether the word, as the vocabulary sees it, is letters alone."""
    return word.isalpha() if word.isascii() else normalize("NFC", word.decode()).lower().isalpha()


class WordIds:
    """Word (bytes without ASCII white space) -> its token ids as little-endian unsigned 32-bit bytes, learned on demand.

    Right for a vocabulary whose pre-tokens never span ASCII white space, so that a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ids: dict[bytes, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        words = self.library.get_vocab()
        #: which ids end a pre-token
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone are single pre-tokens: they are encoded as one text and told apart by the ids that end one."""
        letters = [w for w in words if _letters(w)]
        ids = self._encode(b" ".join(letters).decode())
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) == len(letters):
            raw, at = ids.tobytes(), 0
            for word, end in zip(letters, ends, strict=True):
                self.ids[word] = raw[4 * at : 4 * end]
                at = end
        # The others, or all if some word was several pre-tokens after all: each by itself.
        for word in words:
            if word not in self.ids:
                self.ids[word] = self._encode(word.decode()).tobytes()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        ids = self.ids
        # The vocabulary is lower case; only its special strings tell capitals apart.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        new = set().union(*split).difference(ids)
        # A word of letters with signs behind it is its letters' ids and the signs'.
        tailed = {w: stem for w in new if (stem := w.rstrip(_SIGNS)) != w and _letters(stem)}
        whole = new.difference(tailed).union(tailed.values(), (w[len(stem) :] for w, stem in tailed.items()))
        self._learn(sorted(whole.difference(ids)))
        for word, stem in tailed.items():
            ids[word] = ids[stem] + ids[word[len(stem) :]]
        out = [b"".join(map(ids.__getitem__, words)) for words in split]
        if len(ids) > CACHED_WORDS:
            # What came first is mostly what is frequent; the rest is learned anew where it comes up.
            for word in list(islice(ids, CACHED_WORDS, None)):
                del ids[word]
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer and cache."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, *, tokenizer: str, limit: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut only where longer than ``limit``.

    A null or empty text is the end id alone. ``ids`` are little-endian unsigned 32-bit integers.
    """
    size, end = 4 * limit, np.array([end_id], "<u4").tobytes()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part_of = batch.slice(first, 256)
                rows = []
                for name, ids in zip(part_of.column(0).to_pylist(), word_ids(tokenizer).of(part_of.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        rows.append((name, n, at // 4, len(piece) // 4, zlib.crc32(piece), piece)[: 5 + with_ids])
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("body")).mapInArrow(cut, schema)


class _Stock:
    """How many pieces there are of each length, with the index of sums of two available lengths."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.there = (self.left > 0).astype(np.int64)
        self.there[0] = 0
        n = len(counts)
        #: ordered pairs of available lengths by their sum (sums beyond the capacity are of no use)
        self.pairs = np.convolve(self.there, self.there)[:n]

    def take(self, parts: list[int], times: int) -> None:
        for x in parts:
            self.left[x] -= times
        for x in set(parts):
            if self.left[x] == 0 and self.there[x]:
                room = len(self.pairs) - x
                self.pairs[x:] -= 2 * self.there[:room]
                if 2 * x < len(self.pairs):
                    self.pairs[2 * x] += 1
                self.there[x] = 0

    def times(self, parts: list[int]) -> int:
        return min(self.left[x] // parts.count(x) for x in parts)

    def pair(self, gap: int, most: int, held: list[int]) -> list[int] | None:
        """Two available lengths that fill ``gap``, the longer as long as it can be; ``held`` are in use already."""
        longer = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
        for x in longer[(self.there[longer] > 0) & (self.there[gap - longer] > 0)]:
            parts = [*held, int(x), int(gap - x)]
            if self.times(parts):
                return parts
        return None

    def fill(self, anchor: int, capacity: int) -> list[int] | None:
        """The anchor with one, two or three more lengths that fill the capacity exactly."""
        gap = capacity - anchor
        if gap <= anchor and self.left[gap] and self.times([anchor, gap]):
            return [anchor, gap]
        if self.pairs[gap] and (found := self.pair(gap, anchor, [anchor])):
            return found
        first = np.arange(min(anchor, gap - 2), (gap - 1) // 3, -1)
        for x in first[(self.there[first] > 0) & (self.pairs[gap - first] > 0)]:
            if self.times([anchor, int(x)]) and (found := self.pair(int(gap - x), int(x), [anchor, int(x)])):
                return found
        return None


def packing_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of one sequence, how many such sequences)`` that use up ``counts`` (by length, up to the capacity).

    Longest first, a length takes as many exact fillings as availability allows: one complement, else a pair, else a triple. What is
    left is placed longest first into the open sequences with the smallest gap that takes it, and new ones where none does. Works
    on lengths, not on pieces, so its cost depends on the capacity alone.
    """
    capacity, stock, made = len(counts) - 1, _Stock(counts), []
    if stock.left[capacity]:
        made.append(((capacity,), int(stock.left[capacity])))
        stock.take([capacity], stock.left[capacity])
    for anchor in range(capacity - 1, 0, -1):
        while stock.left[anchor] and (parts := stock.fill(anchor, capacity)):
            times = int(stock.times(parts))
            made.append((tuple(parts), times))
            stock.take(parts, times)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(stock.left[length])
        for gap in sorted(g for g in open_ if g >= length):
            fit = gap // length
            while left and open_[gap]:
                parts, times = open_[gap].pop()
                whole = min(times, left // fit)
                rest = min(left - whole * fit, fit) if whole < times else 0
                for n, how_many in ((fit, whole), (rest, 1 if rest else 0), (0, times - whole - (1 if rest else 0))):
                    if how_many:
                        open_.setdefault(gap - n * length, []).append((parts + (length,) * n, how_many))
                left -= whole * fit + rest
                if not whole or rest:
                    break
        fit = capacity // length
        for n, how_many in ((fit, left // fit), (left % fit, 1 if left % fit else 0)):
            if how_many:
                open_.setdefault(capacity - n * length, []).append(((length,) * n, how_many))
    return made + [x for gap in sorted(open_) for x in open_[gap]]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a row, first sequence, offset), by length and first rank."""
    rows, used, sequence = [], {}, 0
    for parts, times in plan:
        offset = 0
        for length in dict.fromkeys(parts):
            n = parts.count(length)
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``pieces`` (``doc_id, piece, length, ...``) with ``sequence_id`` and ``offset``: its place in a sequence of at most ``capacity``.

    The driver sees one count per length, at most ``capacity`` numbers, and plans on those. Pieces of one length are numbered in a
    fixed order, dealt over slices so that a common length is no task's own; the plan says which numbers go to which
    sequences. It is broadcast: its size is bounded by the capacity. Pieces that repeat an id and number stay separate pieces.
    """
    pieces = durable(pieces)
    found = pieces.groupBy("length").count().collect()
    if any(r["length"] is None or not 0 < r["length"] <= capacity for r in found):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(packing_plan(counts)))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int")
    ranked = running_before(pieces.withColumn("one", F.lit(1)), ["length"], ["doc_id", "piece"], part, "one", "rank").drop("one")
    kept = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(length) else table[:0]
            step = rank - at[:, 1]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(at[:, 3] + step // at[:, 2]), pa.array(at[:, 4] + length * (step % at[:, 2]))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "sequence_id", "offset"])

    return ranked.select(*pieces.columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every document's ids, packed.

    A null or empty text is one piece of one id. Rows that repeat an id are packed each. An empty table gives no rows. Only
    the id and the text are read.
    """
    return pack(token_pieces(docs, tokenizer=tokenizer, limit=capacity, end_id=end_id, doc_id=doc_id, text=text), capacity=capacity)
