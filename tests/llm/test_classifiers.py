from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from molinete.llm.quality import FEATURES, fit_pairs, fit_quality, measures, quality_scores
from molinete.llm.toxicity import ToxicityModel, counterparts, drop_toxic, features, fit_toxicity, fit_weights, swaps_of, toxicity_scores, word_set
from tests.llm.frames import AWKWARD, frame

FOLDER = "/root/testdata/sf0.01"
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_words_and_beginnings():
    assert word_set("Moron### MORON!! it's été") == {b"moron", b"it", b"s", "été".encode()}
    assert features({b"badly", b"badness", b"bad"}) >= {b"badn*", b"badl*", b"badly"}
    assert b"bad" in features({b"bad"}) and not any(f.startswith(b"badl*") for f in features({b"bad"}))
    many = {b"achlich" + x for x in (b"a", b"b", b"c")}
    assert features(many) >= {b"achlich*", b"achlich**", b"achlich***"}
    assert features(many, {b"achl"}) == many | {b"achl*", b"achl**", b"achl***"}


def test_swaps():
    other = counterparts((("women", "men"),), 0)
    assert other == {b"women": b"men", b"men": b"women"}
    ((lost, won),) = swaps_of("No mention here. All women agree!", other)
    assert b"women" in lost and b"men" in won and b"agree" not in lost | won


def test_penalty_takes_weight_off_identity_terms():
    # Feature 0 is an insult, 1 a group named in most toxic rows and few others, 2 its counterpart.
    rows, labels = [[0, 1]] * 30 + [[0]] * 10 + [[1]] * 3 + [[2]] * 30 + [[3]] * 30, np.array([1.0] * 40 + [0.0] * 63)
    swaps = [([1], [2]) for r in rows if 1 in r] + [([2], [1]) for r in rows if 2 in r]
    free = fit_weights(rows, labels, [], 4, swap_penalty=0.0, sparsity=1e-4)
    held = fit_weights(rows, labels, swaps, 4, swap_penalty=5.0, sparsity=1e-4)
    assert abs(free[1] - free[2]) > 1 and abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2])
    assert held[0] > 2


@given_tables
def test_toxicity_on_held_out_documents(spark):
    docs, labels = tables(spark)
    scored = toxicity_scores(docs, fit_toxicity(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() >= 0.93
    assert ((rows.predicted == 1) & (rows.toxic == 0)).sum() <= 2
    assert scored.count() == docs.count()


@given_tables
def test_quality_on_held_out_documents(spark):
    docs, labels = tables(spark)
    scored = quality_scores(docs, fit_quality(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() >= 0.95
    assert ((rows.predicted == 0) & (rows.quality == 1)).sum() <= 1


def test_pairs_learn_an_order():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(0, 1, (400, 3))
    w = fit_pairs(good, bad)
    assert (w > 0).all() and ((good @ w) > (bad @ w)).mean() > 0.85


def test_measures_of_odd_texts():
    assert measures("").tolist() == measures(" \n").tolist() == [0.0] * len(FEATURES)
    for r in AWKWARD:
        assert np.isfinite(measures(r[1] or "")).all()
    at = dict(zip(FEATURES, measures("SHOUT!! SHOUT!! x&&&"), strict=True))
    assert at["shout_words"] == pytest.approx(2 / 3) and at["repeats_next"] == pytest.approx(1 / 3) and at["sign_words"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(None, None, None), (1, 1, 1), (3, 0, 0), (3, None, 1), (7, 1, 0), (99, 1, 1)]])
def test_awkward_tables(spark, labels):
    docs, known = frame(spark, clash=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for scored in (toxicity_scores(docs, fit_toxicity(docs, known)), quality_scores(docs, fit_quality(docs, known))):
        got = scored.collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in AWKWARD)
        assert all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == is_held_out(r.doc_id) for r in got)
    empty = frame(spark, [])
    assert toxicity_scores(empty, fit_toxicity(empty, known)).collect() == []
    assert quality_scores(empty, fit_quality(empty, known)).collect() == []


def test_rejected_documents_go(spark):
    model = ToxicityModel({b"fox": 9.0}, -4.0)
    df = frame(spark, clash=True)
    out = drop_toxic(df, model)
    assert out.columns == df.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r[0]) for r in AWKWARD if "fox" not in (r[1] or ""))
