from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from molinete.llm import pages as pages_module
from molinete.llm import token_counts as token_counts_module
from molinete.llm.context_mixing import BYTES_BACK, Mixer, Model, Vocabulary, batch_of, huffman, odds_of, spelling, OFFSETS
from molinete.llm.lm import score_documents
from molinete.llm.markup import ARTICLE, blocks
from molinete.llm.pages import common_places, main_text
from molinete.llm.search import Postings, Shard, top_documents
from molinete.llm.token_counts import Counts, token_counts
from tests.llm.frames import AWKWARD, awkward_copies, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Token counts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "the", " the", "▁", "<s>", "é", "日本", "\x00", "...", "12", "\r", "ing", "<0x0A>", "🙂", "　", "ﬁ"]), max_size=9))
def test_counts_equal_the_librarys(parts):
    text = "".join(parts)
    assert COUNTS.of(text) == len(LIBRARY.encode(text))


LIBRARY, COUNTS = sentencepiece.SentencePieceProcessor(model_file=MODEL), Counts(MODEL, {})


def test_the_vocabulary_can_be_cut():
    assert COUNTS.splits


def test_token_counts_of_awkward_rows(spark):
    got = token_counts(frame(spark, clash=True), model=MODEL, limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(LIBRARY.encode(r[1] or "")), n > 100) for r in AWKWARD]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got))) == sorted(map(repr, want))
    assert token_counts(frame(spark, []), model=MODEL).collect() == []


def test_frequent_tier_equals_a_brute_count(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["x" * 40, "é", "日本"]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=60)) + "\nnew line  two" for _ in range(300)] + [None, "", "once only"]
    seen = Counter(p for t in texts for p in token_counts_module.pretokens(t or "") if 0 < len(p) <= token_counts_module.LONGEST)
    monkeypatch.setattr(token_counts_module, "FREQUENT", 50)
    monkeypatch.setattr(token_counts_module, "TALLIED", 100)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    steps = {p: math.floor(math.log2(n) * 64) for p, n in seen.items() if n > 1}
    least = min(s for s in [*steps.values(), 10_000] if sum(x >= s for x in steps.values()) <= 50)
    got = token_counts_module.frequent_pretokens(df, MODEL)
    assert got == {p: COUNTS[p] for p, s in steps.items() if s >= least} and 20 < len(got) <= 50
    monkeypatch.setattr(token_counts_module, "FREQUENT", 5000)
    assert set(token_counts_module.frequent_pretokens(df, MODEL)) == set(steps)


# Pages


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 22, 6])
def test_alignment_is_longest(monkeypatch, cells):
    monkeypatch.setattr(pages_module, "_CELLS", cells)
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        places = common_places(np.array(a, np.int64), np.array(b, np.int64)).tolist()
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[i] in rest for i in places) and len(places) == lcs(a, b)


def test_blocks_of_markup():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu<li>more</ul></nav>
    <div class="ad x">buy</div><article><header><h1>Head &amp; line</h1></header><p>one <b>bo</b>ld<br>two<p>three&nbsp;3<span class="share">tweet</span> four</p>
    <div class="comments"><p>first!</p></div><form><p>mail</p></form></article><!-- <p>no</p> --><footer>&copy; x</footer></body></html>"""
    assert " ".join(t for p, t in blocks(html) if p == ARTICLE) == "Head & line one bold two three 3 four"
    assert blocks("") == [] and blocks("a < b") == [(2, "a < b")] and blocks("<p hidden>x</p>y") == [(0, "x"), (2, "y")]
    assert blocks("<p>a</p><script>x") == [(2, "a")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body class='has-sidebar'><article><p>all</p></article></body>", "all"),
        ("<body class='sidebar'><article><p>all</p></article></body>", "all"),
        ("<div id='page-with-nav'><article><p>all</p></article></div>", "all"),
        ("<main class='search-results search'><article class='promo'><p>all</p></article></main>", "all"),
        ("<div class='banner'><p>buy</p><div class='menu'>m</div><div class='search'><article><p>all</p></article></div></div>", "all"),
        ("<div class='banner'><main><p>all</p></main></div>", "all"),
        ("<article><div class='entry-header'><h1>Head</h1></div><div class='header'>line</div><p>all</p><div class='ad-300x250'>buy</div></article>", "Head line all"),
        ("<article><p>all</p><article class='comment'>first</article></article><div class='related-posts'><article>teaser</article></div>", "all"),
        ("<article><p>all</p><div class='x share_buttons'>tweet</div><span class='cookie-notice'>eat</span></article><div id='site-footer'>f</div>", "all"),
    ],
)
def test_names_of_furniture_are_whole_and_spare_articles(html, want):
    assert " ".join(t for p, t in blocks(html) if p == ARTICLE) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<form id='aspnet'><header>top</header><article><p>all</p></article></form>", "all"),
        ("<form class='search'><label><article><p>all</p></article></label><p>mail</p></form>", "all"),
        ("<article><p>all</p><form><label>mail</label><p>send</p></form><fieldset>x</fieldset></article>", "all"),
        ("<article><p title='the hidden valley'>all</p><p data-note='aria-hidden=true display:none'>here</p></article>", "all here"),
        ("<article class='post hidden md:block'><p>all</p></article>", "all"),
        ("<article><div data-id='share' data-class='menu' data-role='search'>all</div></article>", "all"),
        ("<article><p hidden>a</p><p aria-hidden=TRUE>b</p><p style='color:red; Display : None'>c</p><p HIDDEN=''>d</p><p>all</p></article>", "all"),
        ("<article>all<p class=\"x>and more</p></article>", "all and more"),
        ("<article>all<p class='x\nand more</p></article>", "all"),
        ("<article>all <a href=x\nand more", "all and more"),
        ("<article>all<p a='1' class=\"menu\" class='y' / >gone</p></article>", "all"),
        ("<article>1 < 2 <3 </ x><!-- > -->all<!x><?y?></article>", "1 < 2 <3 all"),
    ],
)
def test_attributes_are_read_as_attributes(html, want):
    assert " ".join(t for p, t in blocks(html) if p == ARTICLE) == want


@pytest.mark.parametrize("piece", ["<a b ", '<a b="', "<p class='x' ", "<!-", "<![CDATA[", "</p ", "<p><b>", "<i class=ad>", "<script ", "<a \n", "<p a='>", "</b>", "<form>", "<b class=ad><div class=menu>", "<p id=\"a\" x='"])
def test_crooked_markup_takes_linear_time(piece):
    html = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    assert all("<p" not in text for _, text in blocks(html))
    blocks(f"<article>{html}</b></i></p>>")
    assert time.perf_counter() - start < 20  # two of a megabyte; a quadratic scan took a quarter of an hour for less


def test_shared_lines_of_the_nearest_page_go(spark):
    rows = [
        (1, "http://h/a/1", "<body><div>Top bar</div><p>own one</p><p>same</p><div>Bottom</div>"),
        (2, "http://h/a/2", "<body><div>Top bar</div><p>own two</p><div>Bottom</div>"),
        (3, "http://H/zzz", "<body><div>Other bar</div><p>own two</p>"),
        (4, "http://g/a/1", "<body><div>Top bar</div><p>own one</p>"),
        (5, None, None),
        (6, "not a url", ""),
        (7, "http://c/1", "<p>copy</p><p>of all</p>"),
        (8, "http://c/1?x", "<p>copy</p><p>of all</p>"),
        (8, "http://c/1?x", "<p>copy</p><p>of all</p>"),
        (9, "http://k/1", "<article><p>kept</p><p>licence</p></article><div>rest</div>"),
        (10, "http://k/2", "<article><p>also</p><p>licence</p></article><div>rest</div>"),
        (None, "http://k/3", "<p>x</p>"),
    ]
    want = {
        (1, "own one same"), (2, "own two"), (3, "Other bar"), (4, "Top bar own one"), (5, ""), (6, ""), (7, "copy of all"), (8, "copy of all"), (9, "kept licence"), (10, "also licence"), (None, "x"),
    }
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seen = []
    for parts in ("1", "5"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = main_text(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        seen.append({(r.page_id, r.text) for r in got})
    assert seen == [want, want]
    assert main_text(df.limit(0)).collect() == []


def test_templates_go_where_the_nearest_pages_are_copies(spark):
    top, end = "<div>Top bar of the whole site</div><div>Menu</div>", "<div>Bottom line</div>"
    own = " ".join(f"word{i}" for i in range(40))
    html = {n: f"{top}<p>{n} {own}</p><p>{n} more</p>{end}" for n in ("one", "two", "three")}
    rows = [(i, f"http://h/a/1?x={i:02}", html["one"]) for i in range(30)]  # copies
    rows += [(100 + i, f"http://h/a/2?x={i:02}", html["two"].replace("two more", f"two {i}")) for i in range(30)]  # near copies
    rows += [(200, "http://h/a/3", html["three"]), (201, "http://h/b/1", f"{top}<p>short</p>{end}")]
    rows += [(300 + i, f"http://g/{i}", html["one"].replace("one more", f"one {i}")) for i in range(9)]  # nothing but copies
    want = {i: f"one {own} one more" for i in range(30)} | {100 + i: f"two {own} two {i}" for i in range(30)} | {200: f"three {own} three more", 201: "short"}
    want |= {300 + i: f"Top bar of the whole site Menu one {own} one {i} Bottom line" for i in range(9)}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: r.text for r in main_text(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want


# Language model


def small_model():
    words = [b"the", b"of", b"and", b"a"]
    vocabulary = Vocabulary(words, 3, huffman(np.array([5, 3, 2, 4, 6])), huffman(np.arange(1, 257)))
    rng = np.random.default_rng(0)
    tables = odds_of(rng.integers(0, 30, (OFFSETS[-1], 2)))
    model = Model(vocabulary, tables, Mixer.new(3), Mixer.new(1 + len(BYTES_BACK)))
    model.words.weights += rng.normal(0, 0.2, model.words.weights.shape).astype(np.float32)
    return model


def test_probabilities_of_one_symbol_add_up_to_one():
    # Whatever the context, coded words, the end and the escape share all probability between them.
    model = small_model()
    bits, batch = model.bits([[b"the"], [b"of"], [b"and"], []])
    code = model.vocabulary.word_code
    inputs, gate = model.word_inputs(batch)
    cost = model.words.code(inputs, gate, batch.bits, model.words.costs, 0.0)
    other = model.words.code(inputs, gate, 1 - batch.bits, model.words.costs, 0.0)
    assert np.allclose(np.exp2(-cost) + np.exp2(-other), 1, atol=1e-5)
    # the code is complete
    assert math.isclose(sum(2.0 ** -int(x) for x in code.length), 1.0)
    assert bits.shape == (4,) and (bits > 0).all()


def test_texts_do_not_change_one_another():
    model = small_model()
    texts = [[b"the", b"of", b"xyz"] * 900, [b"the"], [], [b"xyz", b"\xc3\xa9"], [b"a"]]
    together, _ = model.bits(texts)
    alone = [model.bits([t])[0][0] for t in texts]
    assert np.allclose(together, alone)
    empty = batch_of(model.vocabulary, [])
    assert len(empty.bits) == 0
    owner, bits, _, slots = spelling(model.vocabulary, [b"ab", b"b", b"ab"])
    first, last = owner == 0, owner == 2
    assert all((s[first] == s[last]).all() for s in slots) and (bits[first] == bits[last]).all()


@pytest.mark.parametrize("text", [[b"the", b"of"] * 100, [b"\xc3\xa9xyz"] * 40])
def test_weights_move_within_a_short_text(text):
    # Under 4,096 bits of coded words, and bits of spelled ones.
    model = small_model()
    moving = model.bits([text, [b"a"]])[0]
    model.rate = 0.0
    still = model.bits([text, [b"a"]])[0]
    assert moving[0] < 0.97 * still[0] and np.isclose(moving[1], still[1], rtol=0.1)


def brute_base(rows):
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r[1] or "").encode())), None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        repr((r[0], h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)))
        for r, t, h in zip(rows, tokens, held, strict=True)
    )


@pytest.mark.parametrize("known", [262_142, 5])
def test_base_scores_equal_brute_force(spark, known):
    rows = AWKWARD + awkward_copies(40) + [(i, f"some words {i % 7} and more words {i % 11}", "en", "x", 0) for i in range(2000, 2200)]
    got = score_documents(frame(spark, rows, clash=True), known=known, coded=known).collect()
    assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got) == brute_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert all((r.bits_per_byte is None) == (r.n_bytes == 0) for r in got)


def test_scores_without_training_texts(spark):
    assert score_documents(frame(spark, [])).collect() == []
    (row,) = score_documents(frame(spark, [(i, "a b", None, None, None) for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1])).collect()
    assert row.held_out and row.train_tokens == row.n_known == 0 and row.n_tokens == 3 and row.score < 0


# Search


def brute_search(rows, queries, k):
    tallies = [Counter(re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").lower().encode() if (r[1] or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r[1] or "").encode()))) for r in rows]
    n, mean = len(rows), sum(sum(t.values()) for t in tallies) / len(rows)
    spread = Counter(w for t in tallies for w in t)
    out = []
    for q in queries:
        scores = defaultdict(float)
        for w, times in sorted(tallies[q].items()):
            idf = math.log(1 + (n - spread[w] + 0.5) / (spread[w] + 0.5))
            for i, t in enumerate(tallies):
                if w in t:
                    scores[i] += times * idf * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), rows[x[0]][0]))[:k]
        out += [(rows[q][0], rank, rows[i][0], round(s, 6)) for rank, (i, s) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("shard", [20, 8192])
def test_search_equals_brute_force(spark, shard):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), "en", "s", 0) for i in range(300)] + awkward_copies(100) + [r for r in AWKWARD if r[0] is not None and r[0] != 10]
    df = frame(spark, rows, clash=True)
    picked = [i for i, r in enumerate(rows) if r[0] % 10 == 0 and r[0] != 4]
    got = top_documents(df, df.where("doc_id % 10 = 0"), k=5, shard=shard).collect()
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got) == sorted(brute_search(rows, picked, 5))


@pytest.mark.parametrize("seed", range(4))
def test_long_queries_lose_no_copies(seed):
    # Scores of 1e5 in single precision differ by more than any fixed room between rows that are the same.
    rng = np.random.default_rng(seed)
    words = [b"w%d" % i for i in rng.zipf(1.3, 30_000) % 5000]
    postings, text = Postings(), b" ".join(words)
    for name in range(300):
        postings.add(name, text)
        postings.add(1000 + name, b" ".join(words[name :: 300]))
    shard, times = Shard(postings, 15_000, 1.2, 0.75), Counter(words)
    query = sorted(times)
    place, score = shard.top(query, np.array([times[w] * 3.7 for w in query]), 10)
    assert set(shard.ids[place].tolist()) >= set(range(300)) and len(set(score[shard.ids[place] < 1000].tolist())) == 1


def test_search_of_awkward_tables(spark):
    df = frame(spark)
    got = top_documents(df, df, k=3, shard=4).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 7, 8, 9, 10, None, 11, 12}
    assert top_documents(df, df.limit(0)).collect() == []
    assert top_documents(df.limit(0), df).collect() == []


def test_texts_are_scored_with_those_of_like_size():
    """Batches are bounded by bytes and number; every text is in one; one that is too long is alone."""
    from molinete.llm import lm

    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(0, 3000, 2000), [lm.TOGETHER_BYTES * 3, lm.TOGETHER_BYTES, 0]])
    parts = [p.tolist() for p in lm.alike(sizes)]
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(len(p) <= lm.TOGETHER and (len(p) == 1 or sizes[p].sum() <= lm.TOGETHER_BYTES) for p in parts)
    assert [2000] in parts and list(lm.alike(np.zeros(0, np.int64))) == []
