"""What the fourth round's finding asked for: a search whose time for a query and a shard is short."""

import random
from collections import Counter

import numpy as np

from molinete.llm import search
from molinete.llm.search import top_documents


def texts_of(rng, n):
    """Two kinds of texts with frequent words of their own, rare words, copies and empty texts."""
    words = [[f"{kind}{int(rng.paretovariate(0.6))}" for _ in range(400)] for kind in "ab"]
    texts = [" ".join(rng.choices(words[rng.random() < 0.3], k=rng.randint(0, 60))).encode() for _ in range(n)]
    return [*texts, *texts[: n // 5]]


def shard_of(texts, first):
    postings = search.Postings()
    for i, text in enumerate(texts):
        postings.add(first + i, text)
    return search.Shard(search.Lists.of(postings.lists().packed()), 30.0, 1.2, 0.75)


def test_shards_one_after_the_other_find_the_best_of_all(monkeypatch):
    """Queries run side by side over shard after shard; only documents that may be among the best so far are scored in double precision."""
    monkeypatch.setattr(search, "TOGETHER", 16)
    monkeypatch.setattr(search, "TERMS", 100)
    monkeypatch.setattr(search, "PIECE", 50)
    rng = random.Random(6)
    texts = texts_of(rng, 1000)
    parts = [(i, texts[i : i + 200]) for i in range(0, len(texts), 200)]
    queries = [Counter(t.split()) for t in rng.sample(texts, 60) if t]
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in sorted(q)]) for q in queries]
    order = search.by_kind(np.concatenate(ids), np.array([len(x) for x in ids])).tolist()
    assert sorted(order) == list(range(len(queries)))
    queries, ids = [queries[i] for i in order], [ids[i] for i in order]
    weights = [np.array([q[w] * (1.0 + len(w)) for w in sorted(q)]) for q in queries]
    tops, scored = search.Tops(len(queries), 5), []
    for first, part in parts:
        shard = shard_of(part, first)
        found = shard.places(list(number))[np.concatenate(ids)]
        scored.append(0)
        for i, place, score in shard.beating(found, np.concatenate(weights), np.array([len(x) for x in ids]), tops):
            scored[-1] += len(place)
            tops.take(i, score, shard.nameless[place], shard.ids[place])
    for i, (q, weight) in enumerate(zip(queries, weights, strict=True)):
        want = []
        for name, text in enumerate(texts):
            has, size = Counter(text.split()), len(text.split())
            each = [has[w] * 2.2 / (has[w] + 1.2 * (1 - 0.75 + 0.75 * size / 30.0)) * x for w, x in zip(sorted(q), weight, strict=True)]
            want.append((-np.array(each).sum(), name))
        want = sorted(x for x in want if x[0] < 0)[:5]
        assert list(zip(tops.below[i, : tops.size[i]].tolist(), tops.ids[i, : tops.size[i]].tolist(), strict=True)) == want
    assert scored[0] < 0.2 * 60 * 200 and sum(scored[3:]) < 0.6 * scored[0] * len(scored[3:])


def test_frequent_words_as_a_matrix_and_as_lists_are_the_same(monkeypatch):
    rng = random.Random(7)
    shard, words = shard_of(texts_of(rng, 300), 0), [b"a1", b"a2", b"b1", b"b3", b"a77"]
    assert len(shard.dense) and shard.dense.shape[1] % search.LANE == 0
    found, rough = shard.places(words * 2), {}
    for cost in (0, 300):
        monkeypatch.setattr(search, "LIST_COST", cost)
        rough[cost] = shard._rough(found, np.arange(1, 11, dtype=np.float32), np.array([5, 5]))
    assert np.allclose(rough[0], rough[300], rtol=1e-6) and rough[0].any()


def test_search_goes_through_many_shards_in_a_task(spark):
    """A task returns one list of best documents for a query, not one for every shard it went through, and statistics come from the lists of the shards."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(9))) for i in range(200)], "doc_id bigint, text string")
    few = docs.where("doc_id % 40 = 0")
    found = top_documents(docs, few, k=3, shard=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan and "CartesianProduct" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, top_documents(docs, few, k=3).collect()))
