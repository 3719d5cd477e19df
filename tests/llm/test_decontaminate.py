from __future__ import annotations

import hashlib
import random

import pytest

from molinete.llm import queries
from molinete.llm.decontaminate import drop_contaminated, items_by_row, least_hashes, shared_spans, _Hashes
from molinete.llm.terms import terms_of
from tests.llm.frames import AWKWARD, awkward_copies, frame

ITEMS = "item_id bigint, text string"


def words(text):
    return [w.decode() for w in terms_of((text or "").encode())]


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(span, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def run(spark, tmp_path, docs, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.QUERIES["op13_decontaminate"](spark, str(tmp_path)).collect()
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(25)] + [(99, "a b"), (98, "Zz"), (97, None), (10, "a b c d a b c d a b c d a b")]
    docs = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 120)))) for i in range(60)]
    for i in range(40):
        item, at = rng.choice(items[:25])[1].split(), rng.randint(0, 5)
        docs.append((100 + i, " ".join([*rng.choices("efg", k=9), *item[at:], *rng.choices("efg", k=5), *item[:-1]])))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    docs, items = corpus(seed)
    got = run(spark, tmp_path, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), items)
    assert got == brute(docs, items)
    assert 20 < sum("True" in g for g in got) < len(got)


def test_awkward_rows(spark, tmp_path):
    rows = [*AWKWARD, *awkward_copies(40)]
    items = [(1, "the Quick-brown fox; jumps over THE lazy dog"), (2, None), (3, "…"), (4, "one two"), (4, "one two"), (None, "straße quotes"), (5, awkward_copies(1)[0][1]), (6, AWKWARD[7][1])]
    docs = [(r[0], r[1]) for r in rows]
    assert run(spark, tmp_path / "a", frame(spark, rows, clash=True), items) == brute(docs, items)
    assert run(spark, tmp_path / "b", frame(spark, []), items) == []
    assert run(spark, tmp_path / "c", frame(spark, rows), []) == brute(docs, [])


def test_every_long_shared_run_has_a_fingerprint():
    rng = random.Random(3)
    for _ in range(200):
        shared = [b"%d" % rng.randint(0, 6) for _ in range(10)]
        sides = [[b"%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 30))] + shared + [b"%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        a, b = (set(least_hashes(_Hashes().of(s), 10, 5).tolist()) for s in sides)
        assert a & b


def test_spans_are_unions_of_windows(spark):
    items = [(1, "a b c d e"), (2, "d e f g h"), (3, "x")]
    docs = spark.createDataFrame([(7, "z a b c d e f g h z x x z"), (8, "a b c d z")], "doc_id bigint, text string")
    shared = shared_spans(docs, spark.createDataFrame(items, ITEMS), span=5, gram=3)
    assert sorted((r.start, r.end) for r in shared.spans.collect()) == [(1, 9), (10, 11), (11, 12)] or sorted((r.start, r.end) for r in shared.spans.collect()) == [(1, 9), (10, 12)]
    sets, members = items_by_row(shared)
    assert sets.count() == 1 and sorted(r.item for r in members.collect()) == ["1", "2", "3"]
    kept = drop_contaminated(docs.selectExpr("*", "1 AS row", "'x' AS window"), spark.createDataFrame(items, ITEMS), span=5, gram=3)
    assert [tuple(r) for r in kept.collect()] == [(8, "a b c d z", 1, "x")]
