"""What the third round's findings asked for: work that grows with its input, and models of all texts."""

import datetime as dt
import random
import re
from decimal import Decimal as D

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from molinete.llm import lm, search
from molinete.llm.context_mixing import _LEAST, _LEVELS, _PLAIN, _PLACES, BYTES_BACK, OFFSETS, SHORT, Mixer, Model, Tokens, Vocabulary, batch_of, huffman, odds_of, spelling
from molinete.llm.search import top_documents
from molinete.operators import admission
from molinete.sources.roles import Roles

T0 = dt.datetime(2024, 1, 1)
LINE = "request_id bigint, requested_at timestamp_ntz, item_id bigint, delta decimal(12,3), guarded boolean"
STOCK = "item_id bigint, stock decimal(12,3)"


def test_search_writes_queries_once(spark):
    """Shards and parts of the queries meet without a copy of the queries for every shard."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(9))) for i in range(60)], "doc_id bigint, text string")
    found = top_documents(docs, docs.where("doc_id % 10 = 0"), k=3, shard=8)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    whole = top_documents(docs, docs.where("doc_id % 10 = 0"), k=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_mixing_weights_come_from_all_training_texts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["de", "la", "agua", "sol", f"w{i}"]) for _ in range(8))) for i in range(150)]
    texts = lm._texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), "doc_id", "text", 10)
    tallied, keep = [], lm.refined_by
    monkeypatch.setattr(lm, "refined_by", lambda t: tallied.append(t.sum()) or keep(t))
    model, _ = lm.fit_model(texts, lm.word_counts(texts))
    trained = [lm.words_of(bytes(r.body)) for r in texts.where("NOT held_out").collect()]
    assert 0 < len(trained) < 150 and tallied[0] == len(batch_of(model.vocabulary, trained).bits)


def test_many_lines_of_one_item_take_one_round(spark, monkeypatch):
    rng, rounds, bounded = random.Random(3), [], admission._bounded
    monkeypatch.setattr(admission, "_bounded", lambda *a: rounds.append(1) or bounded(*a))
    lines = [(i, T0 + dt.timedelta(minutes=rng.randint(0, 500)), 7, D(rng.choice([3, -2, -5])), True) for i in range(2500)]
    got = admission.admit(spark.createDataFrame(lines, LINE), spark.createDataFrame([(7, D(4))], STOCK), single_line=True)
    level, want = D(4), {}
    for i, _, _, delta, _ in sorted(lines, key=lambda x: (x[1], x[0])):
        want[i] = level + delta >= 0
        level += delta if want[i] else 0
    assert {r.request_id: r.accepted for r in got.collect()} == want and not rounds


def test_bounds_are_moved_once_for_their_requests(spark):
    lines = spark.createDataFrame([(1, T0, 7, D(-1), True), (1, T0, 8, D(-9), True), (2, T0, 7, D(-1), True)], LINE)
    work = lines.select("request_id", "requested_at", "item_id", F.lit(-1000).cast("bigint").alias("delta"), "guarded", F.lit(False).alias("dry"),
                        F.when(F.col("item_id") == 7, 2000).otherwise(500).cast("bigint").alias("base"), F.lit("open").alias("state"))
    judged = admission._by_request(admission._bounded(work, 1000, (3, 2)))
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
    assert {(r.request_id, r.state) for r in judged.collect()} == {(1, "rejected"), (2, "accepted")}


def test_queries_look_their_words_up_apart_and_score_documents_side_by_side():
    """Words are looked up once for many queries, impacts are of single precision, and scores are bit for bit those of one document at a time."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["sol", "mar", "luz", f"w{i % 7}", f"r{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 30))).encode() for i in range(300)]
    postings = search.Postings()
    for i, text in enumerate([*texts, *texts[:80]]):
        postings.add(i, text)
    shard = search.Shard(postings, 15.0, 1.2, 0.75)
    assert shard.impact.dtype == np.float32 and postings.lengths[5] == len(texts[5].split())
    for text in texts[::30]:
        words = sorted(set(text.split())) or [b"no"]
        weights = np.array([1.5 + len(w) for w in words])
        place, score = shard.best(shard.places(words), weights, 3)
        want = {}
        for i, other in enumerate([*texts, *texts[:80]]):
            has, size = other.split(), len(other.split())
            each = [has.count(w) * 2.2 / (has.count(w) + 1.2 * (1 - 0.75 + 0.75 * size / 15.0)) * x if w in has else 0.0 for w, x in zip(words, weights, strict=True)]
            want[i] = np.array(each).sum()
        least = sorted(want.values())[-3]
        got = dict(zip(shard.ids[place].tolist(), score.tolist(), strict=True))
        assert all(got[i] == want[i] for i in got) and {i for i, x in want.items() if x >= least and x > 0} <= set(got)


def test_counts_of_contexts_move_once(spark, monkeypatch):
    """Blocks take as few bytes a count as they can, and one step sums all tasks' blocks of both halves into odds."""
    for most, width in ((200, 1), (60_000, 2), (1 << 30, 4), (1 << 40, 8)):
        counts = np.full(2 * lm._BLOCK, most, np.int64)
        assert len(lm._bytes(counts)) == width * len(counts) and (lm._numbers(lm._bytes(counts)) == most).all()
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["de", "la", "agua", f"w{i % 9}"]) for _ in range(8))) for i in range(90)]
    texts = lm._texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "doc_id", "text", 10)
    kept, fit = [], lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda t, v, odds: kept.append((v, odds)) or fit(t, v, odds))
    lm.fit_model(texts, lm.word_counts(texts))
    (words, odds), trained = kept[0], texts.where("NOT held_out").collect()
    for at, halves in ((0, (0, 1)), (1, (0,)), (2, (1,))):
        found = batch_of(words, [lm.words_of(bytes(r.body)) for r in trained if r.half in halves])
        for k in (0, 1):
            table = lm.BitCounts(lm.TABLES[k])
            table.add(found.slots[k], found.bits)
            assert (odds[at, lm.OFFSETS[k] : lm.OFFSETS[k + 1]] == lm.odds_of(table.total())).all()


def test_lines_of_requests_move_once(spark, tmp_path):
    """Lines are dealt by request alone, so that gathering them by request takes no further shuffle of theirs."""
    spark.sql("SELECT * FROM VALUES (1L, 5L, 1L, 1, 2D), (1L, 5L, 1L, 2, 3D), (1L, 6L, 1L, 3, 1D), (2L, 5L, 1L, 1, 4D) AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate FROM VALUES (1L), (2L), (3L) AS t(id)").write.parquet(f"{tmp_path}/orders.parquet")
    lines = Roles(spark, str(tmp_path)).sale_request_lines
    assert {(r.request_id, r.product_id, r.quantity) for r in lines.collect()} == {(1, 5, D(5)), (1, 6, D(1)), (2, 5, D(4))}
    gathered = lines.hint("merge").groupBy("request_id").agg(F.collect_list("product_id").alias("products"))
    plan = gathered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("product_id") and "hashpartitioning(request_id" in plan and not re.search(r"hashpartitioning\(request_id#\d+L, product_id", plan)


def _one_by_one(mixer, inputs, gate, bits, rate):
    """Bits of information of one text, a bit at a time."""
    weights, refined, shift, total = mixer.weights.copy(), (mixer.refined + _PLAIN) / 2, np.zeros((16, _PLACES)), 0.0
    for begin in range(0, len(bits), SHORT):
        seen, moves, shifts = np.zeros(16), np.zeros(weights.shape), np.zeros(shift.shape)
        for i in range(begin, min(begin + SHORT, len(bits))):
            x, g, bit = np.array([*(k[i] for k in inputs), 1], np.float32), gate[i], int(bits[i])
            level = int((np.clip(weights[g] @ x, -9, 9) + 9) * 64)
            p = np.clip(refined[g, level] + shift[g, level * _PLACES // _LEVELS], _LEAST, 1 - _LEAST)
            total -= np.log2(p if bit else 1 - p)
            seen[g] += 1
            moves[g] += (bit - _PLAIN[level]) * x
            shifts[g, level * _PLACES // _LEVELS] += bit - p
        weights += (rate / (seen + 60))[:, None] * moves
        shift += shifts * (rate / (SHORT / 2))
    return total


def test_texts_side_by_side_cost_what_they_cost_bit_by_bit():
    """Rows of all texts that move together give each text's bits, whatever its length and its bits' gates; words are looked up once for all texts."""
    rng = np.random.default_rng(6)
    known = [b"the", b"of", b"and", b"a", b"w1"]

    class Asked(dict):
        times = 0

        def get(self, *a):
            self.times += 1
            return super().get(*a)

    for most in (3, 60):  # rarely seen contexts, and nearly all of them often
        words = Vocabulary(known, 4, huffman(np.array([5, 3, 2, 4, 4, 6])), huffman(np.arange(1, 257)))
        words.ids = Asked(words.ids)
        model = Model(words, odds_of(rng.integers(0, most, (OFFSETS[-1], 2))), Mixer.new(3), Mixer.new(1 + len(BYTES_BACK)))
        model.words.weights += rng.normal(0, 0.2, model.words.weights.shape).astype(np.float32)
        bodies = [" ".join(f"w{rng.integers(0, 9)}" if rng.random() < 0.3 else ["The", "of", "and", "a"][rng.integers(0, 4)] for _ in range(n)).encode() for n in (0, 1, 700, 3, 90, 41, 700)]
        tokens = lm.tokens_of(words, pa.array(bodies, pa.binary()))
        assert words.ids.times == len({w for b in bodies for w in lm.words_of(b)})
        assert [[tokens.words[i] for i in t.which] for t in (tokens.of_texts(np.array([k])) for k in range(7))] == [lm.words_of(b) for b in bodies]
        assert [n for t in tokens.parts(50) for n in t.lengths] == tokens.lengths.tolist() and len(list(tokens.parts(50))) > 2
        got = model.bits_of(tokens)
        for body, bits in zip(bodies, got, strict=True):
            batch = batch_of(words, [lm.words_of(body)])
            want = _one_by_one(model.words, *model.word_inputs(batch), batch.bits, model.rate)
            _, bit, place, slots = spelling(words, batch.spelled)
            want += _one_by_one(model.bytes, *model.byte_inputs(place, slots), bit, model.rate)
            assert abs(bits - want) < 1e-3 * want
    assert len(model.bits_of(Tokens.of(words, np.zeros(0, np.int64), np.zeros(0, np.intp), []))) == 0


def test_words_are_cut_alike_one_by_one_and_in_columns():
    rng = random.Random(7)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85AbÉß\x00") for _ in range(rng.randint(0, 30))).encode() for _ in range(500)]
    bodies = pa.array(texts, pa.binary()).slice(3)
    lengths, words = lm.words_in(bodies)
    want = [lm.words_of(t) for t in texts[3:]]
    assert lengths.tolist() == [len(t) for t in want] and words.to_pylist() == [w for t in want for w in t]
    assert [t for part in lm.in_turn(bodies) for t in part.to_pylist()] == texts[3:]


def test_groups_of_texts_are_cut_at_steps(monkeypatch):
    """What is learned together does not hang on how many texts are looked up together."""
    monkeypatch.setattr(lm, "TOGETHER_BYTES", 100)
    bodies = pa.array([b"x" * (i % 40) for i in range(150)], pa.binary())
    parts = list(lm.in_turn(bodies, 32))
    assert [len(p) for p in parts] == [32, 32, 32, 32, 22] and [t for p in parts for t in p.to_pylist()] == bodies.to_pylist()
    assert all(len(p) == 1 or sum(map(len, p.to_pylist())) <= 100 for p in lm.in_turn(bodies))
