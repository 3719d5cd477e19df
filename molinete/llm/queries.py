"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molinete.llm.common import durable, read
from molinete.llm.decontaminate import contamination_report
from molinete.llm.exact_dedup import exact_groups
from molinete.llm.lm import score_documents
from molinete.llm.mixing import mix_sources
from molinete.llm.packing import pack_documents
from molinete.llm.pages import main_text
from molinete.llm.prefix_trie import grafted_turns, number_turns, prefix_trie
from molinete.llm.quality import fit_quality, quality_scores
from molinete.llm.ranked_search import ranked_documents
from molinete.llm.search import top_documents
from molinete.llm.simhash import near_groups
from molinete.llm.terms import list_digests
from molinete.llm.token_counts import token_counts
from molinete.llm.toxicity import fit_toxicity, toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SHA-256 of nothing (a fixed value).
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op8_exact_dedup",
    r"""
    WITH texts AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
    ), groups AS (
        SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM texts JOIN groups USING (body)
    """,
)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read(spark, folder, "documents"))


@query(
    "op9_mixing",
    r"""
    WITH sizes AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), catalogue AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source
    ), named AS (
        SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM catalogue
    ), ranked AS (
        SELECT *,
            sum(source_size) OVER () - coalesce(sum(lim) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
            sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining_weight
        FROM named WINDOW l AS (ORDER BY lim * (6 // weight), source NULLS LAST)
    ), opened AS (
        SELECT *, lim * remaining_weight > remaining * weight AS open FROM ranked
    ), level AS (
        SELECT arg_max(remaining, remaining) FILTER (open) AS r, arg_max(remaining_weight, remaining) FILTER (open) AS w FROM opened
    ), targets AS (
        SELECT source, source_size,
            CASE WHEN open THEN CAST(weight AS DOUBLE) * CAST(r AS DOUBLE) / CAST(w AS DOUBLE) ELSE CAST(lim AS DOUBLE) END AS target
        FROM opened, level
    ), placed AS (
        SELECT s.doc_id, s.size, t.source_size, t.target,
            CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || CAST(s.doc_id AS VARCHAR)), s.doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before,
            CAST(floor(t.target + 0.5) AS BIGINT) AS budget
        FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), cut AS (
        SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed
    )
    SELECT doc_id, size, source_size, target,
        CAST(passes * size + greatest(0, least(size, budget - passes * source_size - words_before)) AS BIGINT) AS taken
    FROM cut
    """,
)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read(spark, folder, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(read(spark, folder, "documents"), words_per_shingle=3, max_bits=2)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, read(spark, folder, "labels")))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality_scores(docs, fit_quality(docs, read(spark, folder, "labels"), cut=0.3), cut=0.3)


@query("op5_main_text")
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(read(spark, folder, "pages"))


@query("op6_context_mixing")
def op6_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(read(spark, folder, "documents"), folds=10)


@query("op1_search")
def op1_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return top_documents(docs, docs.where("doc_id % 50 = 0"), k=10)


@query(
    "op11_prefix_trie",
    """
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
        FROM conversations WHERE conv_id IS NOT NULL
    ), whole AS (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY no) AS seq,
            xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))) % 9 AS h
        FROM turns GROUP BY conv_id
    ), rebuilt AS (
        SELECT w.conv_id, list_concat(list_slice(coalesce(o.seq, []), 1, w.h), list_slice(w.seq, w.h + 1, len(w.seq))) AS seq
        FROM whole w LEFT JOIN whole o ON o.conv_id = w.conv_id - w.conv_id % 5
    ), prefixes AS (
        SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt
    ), nodes AS (
        SELECT depth, list_slice(seq, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n,
            string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth) AS ends
        FROM prefixes GROUP BY depth, path
    ), counted AS (
        SELECT p.depth, p.path, p.conv_id, p.n, p.ends, count(c.conv_id) AS n_children,
            CASE WHEN p.depth = 0 THEN 0 ELSE (p.n - 1) * strlen(p.path[p.depth].text) END AS saved
        FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND list_slice(c.path, 1, p.depth) = p.path GROUP BY ALL
    )
    SELECT a.conv_id, a.depth, min(u.conv_id) AS parent_conv_id, a.n AS n_convs, a.n_children,
        CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
    FROM counted a JOIN counted b ON b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path
    LEFT JOIN nodes u ON u.depth = a.depth - 1 AND u.path = list_slice(a.path, 1, a.depth - 1)
    GROUP BY a.conv_id, a.depth, a.n, a.n_children, a.ends
    """,
)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, conversations = grafted_turns(durable(number_turns(read(spark, folder, "conversations"))), group=5, heads=9)
    trie = prefix_trie(durable(turns), conversations)
    ends = list_digests(trie.ends.select("node", F.col("conv_id").alias("no"), F.col("conv_id").cast("string").alias("name")), "node")
    return trie.nodes.join(ends.select("node", "sha256"), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


@query(
    "op12_ranked_search",
    rf"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
    ), postings AS (
        SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
    ), lengths AS (
        SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
    ), totals AS (
        SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM postings, totals GROUP BY term, n_docs
    ), scores AS (
        SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total)))) AS BIGINT) AS score
        FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN lengths l ON l.doc_id = p.doc_id, totals GROUP BY item_id, p.doc_id
    ), ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 20
    """,
)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=20).select("item_id", "rank", "doc_id", "score")


@query(
    "op13_decontaminate",
    rf"""
    WITH doc_words AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), item_words AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), item_starts AS (
        SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS start FROM item_words WHERE len(w) > 0
    ), windows AS (
        SELECT DISTINCT item, size, array_to_string(list_slice(w, start, start + size - 1), ' ') AS body FROM item_starts
    ), sizes AS (
        SELECT DISTINCT size FROM windows
    ), doc_starts AS (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM doc_words, sizes
    ), hits AS (
        SELECT doc_id, start, d.size, item FROM doc_starts d JOIN windows i ON i.size = d.size AND i.body = array_to_string(list_slice(d.w, start, start + d.size - 1), ' ')
    ), places AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS place FROM hits) GROUP BY doc_id
    ), found AS (
        SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    report, lists = contamination_report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return report.join(list_digests(lists, "items"), "items", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"), "contaminated"
    )
