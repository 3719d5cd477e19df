from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from molinete.llm.mixing import mix_sources, mixed_documents, source_targets
from tests.llm.frames import AWKWARD, awkward_copies, frame


def brute_targets(sizes: dict, weights=(1, 2, 3), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = Fraction(total - sum(stopped.values()))
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > repeats * sizes[s]]
        if not over:
            return {**{s: Fraction(v) for s, v in stopped.items()}, **share}
        stopped.update({s: repeats * sizes[s] for s in over})


def sizes_of(rows):
    out = Counter()
    for r in rows:
        out[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    return out


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "B", "é", "zz", "", "m", "n"]), st.integers(0, 1000), min_size=1))
def test_targets_equal_water_filling(spark, sizes):
    rows = [(False, s, n) for s, n in sizes.items()]
    got = source_targets(spark.createDataFrame(rows, "source_null boolean, source_name string, total bigint")).collect()
    want = brute_targets(sizes)
    assert {r.source_name: pytest.approx(float(want[r.source_name]), abs=1e-9) for r in got} == {r.source_name: r.target for r in got}


def test_budgets_are_met_to_the_word(spark):
    rows = AWKWARD + awkward_copies(60)
    got = mix_sources(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    want, sizes = brute_targets(sizes_of(rows)), sizes_of(rows)
    source = {r[0]: r[3] for r in rows}
    taken, targets = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
    for s, target in targets.items():
        assert target == pytest.approx(float(want[s])) and abs(taken[s] - target) <= 0.5 + 1e-9


def test_reruns_agree(spark):
    df = frame(spark, AWKWARD + awkward_copies(30))
    once = sorted(mix_sources(df).collect(), key=repr)
    assert once == sorted(mix_sources(df.repartition(7)).collect(), key=repr)


def test_rows_of_the_mix(spark):
    rows = AWKWARD + awkward_copies(60)
    df = frame(spark, rows, clash=True)
    out = mixed_documents(df)
    assert out.columns == df.columns
    got, want = Counter(), brute_targets(sizes_of(rows))
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    longest = {s: max(len((r[1] or "").split()) for r in rows if r[3] == s) for s in want}
    for s, target in want.items():
        assert abs(got[s] - target) <= longest[s] / 2 + 1
    # documents without words stay, once
    assert sorted(r.doc_id for r in out.where("doc_id IN (4, 5, 6)").collect()) == [4, 5, 6]


def test_empty_and_wordless_tables(spark):
    assert mix_sources(frame(spark, [])).collect() == []
    got = mix_sources(frame(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
