"""Language-model scores of documents: counts of all training texts, a mixing model, and the unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, held_out, text_of
from molinete.llm.context_mixing import BYTES_BACK, OFFSETS, TABLES, WORDS, BitCounts, Mixer, Model, Tokens, Vocabulary, batch_of, huffman, learn_texts, no_levels, odds_of, refined_by, spelling

#: Words with a code of their own; words whose counts every worker holds (both bounds on what is broadcast).
CODED, KNOWN = 131_070, 131_070
#: Texts that a task learns its first weights from, in ``TURNS`` turns; the others move these on.
FIRST_TEXTS, TURNS = 64, 4
#: The end of a text in the count table; no word holds a space.
END = " "
_BLOCK = 4096
#: Texts and bytes that are scored side by side.
TOGETHER, TOGETHER_BYTES = 2048, 3 << 19


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.lower().split()


def words_in(bodies: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same of many texts: how many words each has, and all words in a row."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(bodies.view(pa.string())))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    return np.bincount(owner.filter(real).to_numpy(), minlength=len(bodies)), words.filter(real).view(pa.binary())


def _listed(column: pa.Array) -> list:
    """A column's values, sooner than one by one."""
    return column.to_numpy(zero_copy_only=False).tolist()


def tokens_of(vocabulary: Vocabulary, bodies: pa.Array) -> Tokens:
    lengths, words = words_in(bodies)
    places = words.dictionary_encode()
    return Tokens.of(vocabulary, lengths, places.indices.to_numpy().astype(np.intp), _listed(places.dictionary))


def in_turn(bodies: pa.Array, step: int = 1) -> Iterator[pa.Array]:
    """Texts in their order: at most ``TOGETHER`` texts and ``TOGETHER_BYTES`` bytes at a time, or one text; cut only before every ``step``-th one."""
    begin = held = 0
    for i, size in enumerate(pc.binary_length(bodies).to_pylist()):
        if i > begin and i % step == 0 and (i - begin >= TOGETHER or held + size > TOGETHER_BYTES):
            yield bodies.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(bodies):
        yield bodies.slice(begin)


def _texts(docs: DataFrame, doc_id: str, text: str, folds: int) -> DataFrame:
    """``(row, doc_id, held_out, half, body)``; ``row`` tells rows apart that repeat an id, equal texts lie in one half."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id), folds).alias("held_out"),
        F.pmod(F.xxhash64(text_of(text)), F.lit(2)).cast("int").alias("half"),
        text_of(text).cast("binary").alias("body"),
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all training texts, ends of texts among them; merged per task before the shuffle."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for body in batch.column(0):
                seen.update(words_of(body.as_py()))
                seen[END.encode()] += 1
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    return texts.where(~F.col("held_out")).select("body").mapInArrow(tally, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(table: np.ndarray, first: int) -> pa.RecordBatch:
    """The blocks of a task's counts that are not all zero, in as few bytes a count as they take; ``first`` is the number of the first."""
    parts = table.reshape(-1, 2 * _BLOCK)
    used = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(used + first, pa.int32()), pa.array([_bytes(parts[i]) for i in used], pa.binary())], ["block", "counts"])


def _bytes(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return counts.astype(next(k for k, n in (("u1", 8), ("<u2", 16), ("<i4", 31), ("<i8", 64)) if most < 1 << n)).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    """A block's counts, of one to eight bytes each."""
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<i4", 8: "<i8"}[len(raw) // (2 * _BLOCK)])


def hashed_counts(texts: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The odds in every slot of the hashed tables, three times: from all training texts, and from either half of them.

    A task counts into tables of fixed size and hands over the blocks it has touched; a block of all tasks and both halves is summed and turned
    into odds at once, so counts move once. Contexts inside words come from the count table: a word without
    a code as often as it stands in the texts, one with a code once, as a model of its kind. The result's size is fixed by the tables.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    every = OFFSETS[-1] // _BLOCK

    def of_half(half: int) -> DataFrame:
        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, words = [BitCounts(n) for n in TABLES[:2]], shared.value
            for batch in batches:
                for part in (p for bodies in in_turn(batch.column(0)) for p in tokens_of(words, bodies).parts(WORDS)):
                    found = batch_of(words, part)
                    for table, slots in zip(tables, found.slots, strict=True):
                        table.add(slots, found.bits)
            yield from (_blocks(table.total(), (1 + half) * every + OFFSETS[k] // _BLOCK) for k, table in enumerate(tables))

        return texts.where(~F.col("held_out") & (F.col("half") == half)).select("body").coalesce(tasks).mapInArrow(of_texts, schema)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, words = [BitCounts(n) for n in TABLES[2:]], shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 8_000):
                part = [(w, n) for w, n in zip(*map(_listed, batch.slice(at, 8_000).columns), strict=True) if w != END.encode()]
                owner, bits, _, slots = spelling(words, [w for w, _ in part])
                times = np.array([1 if words.ids.get(w, words.coded) < words.coded else n for w, n in part], float)[owner]
                for table, own in zip(tables, slots, strict=True):
                    table.add(own, bits, times)
        yield from (_blocks(table.total(), OFFSETS[k + 2] // _BLOCK) for k, table in enumerate(tables))

    schema = "block int, counts binary"
    # A task's tables have their size whatever it reads, so there are only a few tasks for each core, however many files.
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    made = of_half(0).union(of_half(1)).union(counts.select("word", "n").coalesce(tasks).mapInArrow(of_words, schema))
    odds = np.zeros(3 * OFFSETS[-1], np.int16)
    odds[:] = odds_of(np.zeros((1, 2)))[0]

    def summed(group: pa.Table) -> pa.Table:
        # A half's blocks count for the half and for all.
        totals: dict[int, np.ndarray] = {}
        for block, raw in zip(group.column("block").to_pylist(), group.column("counts"), strict=True):
            found = _numbers(raw.as_py())
            for at in {block, block % every}:
                totals.setdefault(at, np.zeros(2 * _BLOCK, np.int64))
                totals[at] += found
        as_odds = [odds_of(t.reshape(-1, 2)).astype("<i2").tobytes() for t in totals.values()]
        return pa.table({"block": pa.array(list(totals), pa.int32()), "odds": pa.array(as_odds, pa.binary())})

    for row in made.groupBy(F.col("block") % every).applyInArrow(summed, "block int, odds binary").collect():
        odds[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["odds"], "<i2")
    odds = odds.reshape(3, -1)
    odds[1:, OFFSETS[2] :] = odds[0, OFFSETS[2] :]  # contexts inside words do not come from the texts
    return odds


def fit_weights(texts: DataFrame, vocabulary: Vocabulary, odds: np.ndarray) -> Model:
    """The model whose weights and maps come from all training texts, each seen with the tables of the half it is not in.

    A task moves weights on over all of its texts; weights are averaged by gate, each task's by the bits it saw there, and the levels that were met are
    added up. What comes to the driver is of fixed size for each task, and there are only a few tasks for each core.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, odds[1:]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, halves = shared.value
        first, cells, begun = [], no_levels(), False
        model = Model(words, halves[0], Mixer.new(3), Mixer.new(1 + len(BYTES_BACK)))

        def over(tokens: Tokens, own: np.ndarray, rate: float, tally: tuple[np.ndarray, np.ndarray] | None) -> None:
            for half in (0, 1):
                model.tables, rows = halves[1 - half], np.flatnonzero(own == half)
                for at in range(0, len(rows), 16):
                    learn_texts(model, tokens.of_texts(rows[at : at + 16]), rate, tally)

        def begin() -> None:
            own, bodies = np.array([h for h, _ in first]), pa.array([b for _, b in first], pa.binary())
            for turn in range(TURNS):
                over(tokens_of(words, bodies), own, 1.0 / (turn + 1), cells if turn == TURNS - 1 else None)

        for batch in batches:
            done = 0
            for bodies in in_turn(batch.column("body"), 32):
                own, tokens = batch.column("half").slice(done, len(bodies)).to_numpy(), tokens_of(words, bodies)
                done += len(bodies)
                for at in range(0, len(bodies), 32):
                    if begun:
                        rows = np.arange(at, min(at + 32, len(bodies)))
                        over(tokens.of_texts(rows), own[rows], 1.0 / TURNS, cells)
                        continue
                    first += zip(own[at : at + 32].tolist(), bodies.slice(at, 32).to_pylist(), strict=True)
                    if len(first) >= FIRST_TEXTS:
                        begin()
                        first, begun = [], True
        if not begun:
            begin()
        found = [x.astype("<f8").tobytes() for x in (model.words.weights, model.bytes.weights, *cells)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], ["words", "bytes", "word_levels", "byte_levels"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    read = texts.where(~F.col("held_out")).select("half", "body").coalesce(tasks)
    rows = read.mapInArrow(learn, "words binary, bytes binary, word_levels binary, byte_levels binary").collect()
    shared.unpersist()
    model = Model(vocabulary, odds[0], Mixer.new(3), Mixer.new(1 + len(BYTES_BACK)))
    for mixer, name, levels in ((model.words, "words", "word_levels"), (model.bytes, "bytes", "byte_levels")):
        tallies = [np.frombuffer(r[levels], "<f8") for r in rows]
        seen = np.array([t.reshape(16, -1).sum(axis=1) for t in tallies]).reshape(-1, 16, 1)
        weights = np.array([np.frombuffer(r[name], "<f8") for r in rows]).reshape(-1, *mixer.weights.shape)
        total = seen.sum(axis=0)
        mean = (weights * seen).sum(axis=0) / np.maximum(total, 1)
        mixer.weights = np.where(total > 0, mean, mixer.weights).astype(np.float32)
        if total.any():
            mixer.refined = refined_by(sum(tallies))
    return model


def fit_model(texts: DataFrame, counts: DataFrame, *, coded: int = CODED, known: int = KNOWN) -> tuple[Model, np.ndarray]:
    """The model, and how often each word of its vocabulary stands in the training texts (the last number is the ends).

    The ``known`` most frequent words are the vocabulary (a fixed bound), the first ``coded`` of them have a code; code lengths and the first predictor follow
    from the counts of all words. Weights are fitted online on all training texts (:func:`fit_weights`).
    """
    end = counts.where(F.col("word") == F.lit(END).cast("binary")).agg(F.sum("n")).first()[0] or 0
    plain = counts.where(F.col("word") != F.lit(END).cast("binary"))
    # The smallest count that at most ``known`` words reach; counts beyond 65,536 are one row, so few numbers come here.
    steps = sorted(((r["m"], r["words"]) for r in plain.groupBy(F.least("n", F.lit(1 << 16)).alias("m")).agg(F.count("*").alias("words")).collect()), reverse=True)
    reach = np.cumsum([w for _, w in steps])
    floor = next((m for (m, _), r in zip(reversed(steps), reversed(reach), strict=True) if r <= known), 1 << 62)
    found = plain.where(F.col("n") >= floor).select("word", "n").toArrow()
    top = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    all_words = plain.agg(F.sum("n")).first()[0] or 0
    often = np.array([n for _, n in top], np.int64)
    coded = min(coded, int((often > 1).sum()))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        for batch in batches:
            words, times = _listed(batch.column(0)), batch.column(1).to_numpy()
            raw = np.frombuffer(b"".join(words), np.uint8)
            # Counts of a batch are far below 2^53, so their sums are exact.
            seen += np.bincount(raw, np.repeat(times, [len(w) for w in words]), 256).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(seen)], ["byte", "n"])

    bytes_ = np.ones(256, np.int64)
    # Letters of the words without a code: what is rare enough, whatever its rank.
    rare = plain.where(F.col("n") <= (int(often[coded - 1]) if coded else 1 << 62))
    for row in rare.select("word", "n").mapInArrow(letters, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        bytes_[row["byte"]] += row["n"]
    spelled = int(all_words - often[:coded].sum())
    bytes_[32] += spelled
    word_code = huffman(np.append(often[:coded], [max(1, end), max(1, spelled)]))
    vocabulary = Vocabulary([w for w, _ in top], coded, word_code, huffman(bytes_))
    return fit_weights(texts, vocabulary, hashed_counts(texts, counts, vocabulary)), np.append(often, end)


def alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of texts of like size, by rising size: at most ``TOGETHER`` texts and ``TOGETHER_BYTES`` bytes at a time, or one text.

    Texts are scored side by side, bit for bit, so those of like size waste no steps, and memory is bounded by bytes and not by their number.
    """
    order = np.argsort(sizes, kind="stable")
    begin, held = 0, 0
    for i, size in enumerate(sizes[order].tolist()):
        if i > begin and (i - begin == TOGETHER or held + size > TOGETHER_BYTES):
            yield order[begin:i]
            begin, held = i, 0
        held += size
    if begin < len(order):
        yield order[begin:]


def score_documents(docs: DataFrame, *, folds: int = 10, coded: int = CODED, known: int = KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)`` for every row of ``docs``.

    ``score`` is the model's log10 probability of the text's words and end. Coded words are bits on the path of a Huffman code, other words an escape and the bits of their
    bytes; the probability of each bit mixes the logistic odds of three predictors: by counts alone, and by hashed tables under the last landmark word and the last two words
    (three and five bytes before). Weights are gated by how often the contexts were seen; a map by gate refines the mixed odds. Both move on within a text, gate by gate.

    ``base_score`` adds ``log10((c + 0.1) / (N + 0.1 (V + 1)))`` over the tokens. Counts of the known words are broadcast; the others, rare words all, are
    joined by word, so no key is hot, and summed per row.

    A null text is empty: one token, its end, no bytes and null ``bits_per_byte``. Rows that repeat an id are scored each. Without training texts all counts
    are zero and the model knows bytes alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = _texts(docs, doc_id, text, folds)
    counts = durable(word_counts(texts))
    model, often = fit_model(texts, counts, coded=coded, known=known)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared, logs = spark.sparkContext.broadcast(model), np.log10(often + 0.1)
    end_log, end_known = float(logs[-1]), int(often[-1] > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for rows in alike(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)):
                part = batch.take(pa.array(rows))
                found = tokens_of(fitted.vocabulary, part.column("body"))
                bits = fitted.bits_of(found)
                texts, distinct = len(rows), len(found.words)
                owner, ids = np.repeat(np.arange(texts), found.lengths), found.ids.take(found.which)
                here = ids >= 0
                base = np.bincount(owner[here], logs[ids[here]], texts) + end_log
                seen = np.bincount(owner[here], minlength=texts) + end_known
                # In front, under a name no word has, the row itself, with what needs no join; then its unknown words.
                pairs, times = np.unique(np.concatenate([np.arange(texts) * (distinct + 1), (owner * (distinct + 1) + 1 + found.which)[~here]]), return_counts=True)
                whose, word = np.divmod(pairs, distinct + 1)
                ends = np.append(0, np.cumsum(np.bincount(whose, minlength=texts))).astype(np.int32)
                words = pa.array([b" ", *found.words], pa.binary()).take(pa.array(word))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "doc_id", "held_out")),
                        pa.array(found.lengths + 1),
                        pa.array(seen),
                        pa.array(base),
                        pa.array(-bits * np.log10(2.0)),
                        pc.binary_length(part.column("body")).cast(pa.int64()),
                        pa.ListArray.from_arrays(ends, words),
                        pa.ListArray.from_arrays(ends, pa.array(np.where(word > 0, times, 0))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "seen", "base", "score", "n_bytes", "words", "times"],
                )

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, seen bigint, base double, score double, n_bytes bigint, words array<binary>, times array<bigint>"
    scored = texts.select("row", "doc_id", "held_out", "body").mapInArrow(score, schema)
    facts = ["doc_id", "held_out", "n_tokens", "seen", "base", "score", "n_bytes"]
    own = F.col("w.times") == 0
    each = scored.select("row", *facts, F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row",
        *(F.when(own, F.col(c)).alias(c) for c in facts),
        # The row's own entry has a key of its own, so that these do not meet in one task.
        F.when(own, F.concat(F.lit(" ").cast("binary"), F.col("row").cast("string").cast("binary"))).otherwise(F.col("w.words")).alias("word"),
        F.col("w.times").alias("times"),
    )
    joined = each.join(counts.where(F.col("word") != F.lit(END).cast("binary")), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = joined.groupBy("row").agg(
        *(F.max(x).alias(x) for x in facts),
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_seen"),
    )
    share = float(np.log10(total + 0.1 * (distinct + 1)))
    return sums.select(
        F.col("doc_id").alias("doc_id"),
        F.col("held_out").alias("held_out"),
        F.col("n_tokens").alias("n_tokens"),
        (F.col("seen") + F.col("rare_seen")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n_tokens") * share).alias("base_score"),
        F.col("score").alias("score"),
        F.col("n_bytes").alias("n_bytes"),
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
