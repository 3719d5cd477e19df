"""Token counts by lookup: a broadcast table of frequent pre-tokens, then each worker's own cache."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, text_of

#: Pre-tokens of the frequent tier and characters of one (a documented bound: it only saves time, counts never depend on it).
FREQUENT, LONGEST = 65_536, 32
#: Pre-tokens a task counts before it hands its counts over and starts anew.
TALLIED = 500_000
#: Entries of a worker's cache; beyond that it starts anew.
CACHED = 400_000

_MARK = "▁"
#: A run of spaces with the word behind it, or one line feed.
_PRETOKEN = re.compile(r"\n| *[^ \n]+| +")


class Counts(dict):
    """Pre-token -> number of tokens. The first tier is given, the second fills on demand.

    A pre-token is a run of spaces with what follows up to the next space or line feed, written with a space in front where the
    vocabulary would put its mark, or with a line feed in front where it begins a line. Right for vocabularies in which the
    mark stands only at the front of a piece and no piece holds a line feed; ``__init__`` checks that and falls back to whole texts.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent, self.library = frequent, sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        probe = ["a", "\n", "a\nb", "a b", " a", "a ", "  a\n  b "]
        self.splits = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces) and all(self._by_parts(x) == len(self.library.encode(x)) for x in probe)

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        # Behind a line feed, which joins no piece, the library adds nothing of its own: its mark and the feed come in front.
        behind = token[0] != "\n"
        found = len(self.library.encode("\n" + token if behind else token, num_threads=1)) - 1 - behind
        self[token] = found
        return found

    def _by_parts(self, text: str) -> int:
        if text[0] == " " or "  " in text or " \n" in text:
            # Every line but the first starts without a mark; a run of spaces belongs to the word behind it.
            total, at_start = 0, False
            for part in _PRETOKEN.findall(" " + text):
                if part == "\n":
                    if at_start:
                        total += self["\n"]
                    at_start = True
                elif at_start:
                    total += self["\n" + part]
                    at_start = False
                else:
                    total += self[part]
            return total + (self["\n"] if at_start else 0)
        return sum(map(self.__getitem__, pretokens(text)))

    def of(self, text: str) -> int:
        if not text:
            return len(self.library.encode(text))
        if not self.splits or _MARK in text or "\x00" in text:
            return len(self.library.encode(text, num_threads=1))
        return self._by_parts(text)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text without a space in front, two in a row or one before a line feed."""
    return [" " + p if p[:1] != "\n" else p for p in text.replace("\n", " \n").split(" ")]


_LOADED: dict[str, Counts] = {}


def frequent_pretokens(docs: DataFrame, model: str, *, text: str = "text") -> dict[str, int]:
    """The first tier: the most frequent pre-tokens of all texts, with their lengths in tokens.

    All that occur more often than some number, the least (of steps of a hundredth) that leaves at most ``FREQUENT``; none of more than ``LONGEST`` characters.
    Every task counts its own texts; only its distinct pre-tokens with their counts are added up, so neither texts nor their pre-tokens are
    shuffled. The driver sees how many there are at each step of frequency, and then the tier alone.
    """
    counts = Counts(model, {})
    if not counts.splits:
        return {}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(p, n) for p, n in seen.items() if 0 < len(p) <= LONGEST]
            words, sums = zip(*kept, strict=True) if kept else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sums, pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for body in batch.column(0):
                seen.update(pretokens(body.as_py()))
                if len(seen) > TALLIED:
                    yield flush()
                    seen.clear()
        yield flush()

    sums = docs.select(text_of(text).alias("body")).mapInArrow(tally, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))
    stepped = durable(sums.where("n > 1").withColumn("step", F.floor(F.log2("n") * 64).cast("int")))
    above, least = 0, 0
    for r in sorted(stepped.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # at most 64 steps for each doubling
        above += r["n"]
        if above > FREQUENT:
            least = r["step"] + 1
            break
    return {r["pretoken"]: counts[r["pretoken"]] for r in stepped.where(F.col("step") >= least).select("pretoken").collect()}


def token_counts(docs: DataFrame, *, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, as the library counts the whole text.

    One pass over the texts makes the frequent tier, which is broadcast (its size is bounded); in a second, everything else is encoded
    by the library once per worker and kept in a bounded cache. No text is shuffled. A null text is empty; texts that hold the vocabulary's own mark or a null
    character go to the library whole. An empty table gives no rows.
    """
    tier = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, model, text=text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model} {tier.id if hasattr(tier, 'id') else id(tier)}"
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Counts(model, tier.value)
        of = _LOADED[key].of
        for batch in batches:
            sizes, tokens = [], []
            for body in batch.column(1):
                body = body.as_py()
                sizes.append(len(body.encode()))
                tokens.append(of(body))
            tokens = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
