from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from molinete.llm import queries, ranked_search
from molinete.llm.ranked_search import BLOCK_TERMS, ranked_documents
from molinete.llm.terms import terms_of
from tests.llm.frames import AWKWARD, awkward_copies, frame

ITEMS = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, place + 1, None if none else i, -s) for place, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def got(spark, docs, items, **named):
    rows = ranked_documents(docs, spark.createDataFrame(items, ITEMS), **named).collect()
    return sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in rows)


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(size)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(12)] + [(50, docs[3][1]), (51, "none of these"), (52, docs[7][1] + " w59")]
    return docs, items


def test_terms_are_those_of_the_pattern():
    for text in [*(r[1] or "" for r in AWKWARD), "AbÇ d-e_f 12.5", "\x00a\x7fb\x80c İ ſ K", "".join(map(chr, range(300)))]:
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize(("block_terms", "bucket"), [(BLOCK_TERMS, 1024), (30, 16)])
def test_ranks_equal_brute_force(spark, block_terms, bucket):
    docs, items = corpus(block_terms)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert got(spark, df, items, k=7, block_terms=block_terms, bucket=bucket) == brute(docs, items, 7)


def test_awkward_rows(spark):
    rows = [*AWKWARD, *awkward_copies(30), (None, "the quick brown fox", "en", "a", 1)]
    items = [(1, "the QUICK brown fox"), (1, "the QUICK brown fox"), (None, "one two"), (2, None), (3, "?!"), (4, "ßtraße 日本語"), (5, "word5 " * 400), (6, AWKWARD[7][1])]
    want = brute([(r[0], r[1]) for r in rows], items, 5)
    assert got(spark, frame(spark, rows, clash=True), items, k=5) == want
    assert got(spark, frame(spark, []), items) == [] and got(spark, frame(spark, rows), []) == []
    assert got(spark, frame(spark, [(1, None, "en", "a", 0)]), items) == []


def test_what_cannot_reach_the_threshold_is_not_scored(spark, monkeypatch):
    """The counts behind the results: pairs met, pairs left after the length bound, pairs scored."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(rng.choices(words, k=8 if i % 3 else 120))) for i in range(1500)]
    items = [(i, docs[i * 3][1]) for i in range(20)]
    seen = {}

    def watched(*arguments, keep=ranked_search.search_buckets):
        out = keep(*arguments)
        if arguments[3] is not None:
            seen.update({r.row: r.n for r in out.where("row < 0").groupBy("row").agg({"score": "sum"}).withColumnRenamed("sum(score)", "n").collect()})
        return out

    monkeypatch.setattr(ranked_search, "search_buckets", watched)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(spark, df, items, k=1, bucket=64) == brute(docs, items, 1)
    met, left, scored = seen[-1], seen[-2], seen[-3]
    assert met == 20 * 1500 and left < met * 0.8 and scored < left * 0.5


def test_query_equals_brute_force(spark, tmp_path):
    docs, items = corpus(8, 60)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.QUERIES["op12_ranked_search"](spark, str(tmp_path)).collect()
    assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in rows) == brute(docs, items, 20)
