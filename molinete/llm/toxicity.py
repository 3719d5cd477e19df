"""Toxicity: a logistic classifier on words whose scores must not change when identity terms are swapped."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import held_out, text_of
from molinete.llm.labelled import SAMPLE_ROWS, training_sample

#: Identity terms by kind. Terms of one line are each other's counterparts.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("transgender", "cisgender", "nonbinary"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("americans", "mexicans", "germans", "french", "spaniards", "chinese"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)

#: Lengths in bytes of the word beginnings that count as features, for languages that build long words.
PREFIXES = (4, 5, 6, 7)

#: Every byte that is neither an ASCII letter nor part of a longer character separates words.
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def word_set(text: str) -> set[bytes]:
    """The distinct lower-case words of a whole text; signs and digits separate words."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def features(words: set[bytes], known: set[bytes] | None = None) -> set[bytes]:
    """The words, and ``p*``, ``p**``, ``p***`` for each beginning ``p`` that at least one, two, three longer words have.

    ``known`` limits the beginnings looked at.
    """
    tally = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k and (known is None or w[:k] in known))
    return words | {p + b"*" * n for p, times in tally.items() for n in range(1, min(times, 3) + 1)}


def sentences(text: str) -> list[str]:
    for end in "!?\n":
        text = text.replace(end, ".")
    return [s for s in text.split(".") if s.strip()]


def swaps_of(text: str, other: dict[bytes, bytes]) -> set[tuple[frozenset[bytes], frozenset[bytes]]]:
    """For each sentence with identity terms: the features it loses and those it gains when they are swapped."""
    out = set()
    for sentence in sentences(text):
        words = word_set(sentence)
        if words & other.keys():
            own, new = features(words), features({other.get(w, w) for w in words})
            out.add((frozenset(own - new), frozenset(new - own)))
    return out


def counterparts(groups: tuple[tuple[str, ...], ...], turn: int) -> dict[bytes, bytes]:
    """Each term's counterpart, ``turn`` places further round its line."""
    return {a.encode(): line[(i + 1 + turn % (len(line) - 1)) % len(line)].encode() for line in groups for i, a in enumerate(line) if len(line) > 1}


@dataclass
class ToxicityModel:
    """Weights by feature and a bias; the score is the logistic of their sum over a text's features."""

    weights: dict[bytes, float]
    bias: float

    def score(self, text: str) -> float:
        here = features(word_set(text), self.beginnings)
        total = self.bias + sum(map(self.weights.__getitem__, sorted(self.weights.keys() & here)))
        return float(1 / (1 + np.exp(-total)))

    @cached_property
    def beginnings(self) -> set[bytes]:
        return {w.rstrip(b"*") for w in self.weights if w.endswith(b"*")}

    def column(self, text: Column) -> Column:
        score = self.score

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return texts.map(score).astype("float64")

        return scored(text)


def fit_weights(rows: list[list[int]], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], width: int, *, swap_penalty: float, sparsity: float, steps: int = 400) -> np.ndarray:
    """Weights (the last is the bias) of present features: mean log loss, plus ``swap_penalty`` times the mean squared change of the
    score under a swap, plus ``sparsity`` times the sum of absolute weights; by accelerated proximal gradient steps."""
    n, index = len(rows), np.array([j for r in rows for j in r], np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    s_index = np.array([j for a, b in swaps for j in (*a, *b)], np.int64)
    s_sign = np.array([v for a, b in swaps for v in (*[-1.0] * len(a), *[1.0] * len(b))])
    s_owner = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])
    per_class = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w = np.zeros(width + 1)
    look, momentum = w.copy(), 1.0
    # A bound of the curvature: squared row lengths weighted as the loss weighs them.
    longest = np.bincount(owner, minlength=n).astype(float) + 1
    bound = 0.25 * float((per_class * longest).sum())
    if len(swaps):
        bound += 2 * swap_penalty * float(np.bincount(s_owner, s_sign**2, len(swaps)).mean())
    for _ in range(steps):
        z = np.bincount(owner, look[index], n) + look[-1]
        error = per_class * (1 / (1 + np.exp(-z)) - labels)
        slope = np.append(np.bincount(index, error[owner], width), error.sum())
        if len(swaps):
            change = np.bincount(s_owner, s_sign * look[s_index], len(swaps)) * (2 * swap_penalty / len(swaps))
            slope[:width] += np.bincount(s_index, s_sign * change[s_owner], width)
        step = look - slope / bound
        step[:-1] = np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - sparsity / bound, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, w, momentum = step + (momentum - 1) / following * (step - w), step, following
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    swap_penalty: float = 1.0,
    sparsity: float = 0.002,
    candidates: int = 4096,
    sample_rows: int = SAMPLE_ROWS,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """A :class:`ToxicityModel` from the ``toxic`` labels outside the held-out fold.

    Fitted on at most ``sample_rows`` labelled documents. Candidates are the ``candidates`` features whose share of toxic and of other
    documents differ most for their standard error; identity terms are always among them. Each labelled sentence with an
    identity term gives a counterfactual in which its terms are swapped; the squared change of score is penalised, so a mention
    of a group cannot carry weight that its counterparts do not. Absolute weights are penalised too, so features that only
    come along with toxic ones get none. Both classes weigh the same. Without labels of both kinds all scores are the share of toxic labels.
    """
    sample = training_sample(docs, labels, "toxic", rows=sample_rows, folds=folds, doc_id=doc_id, text=text)
    sums = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return ToxicityModel({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for body, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[label].update(features(word_set(body.as_py())))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], ["word", "c", "t"])

    words = sample.select("body", "label").mapInArrow(tally, "word binary, c bigint, t bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    share = (F.col("c") + F.col("t")) / (clean + toxic)
    error = F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
    far = F.when(error > 0, (F.col("t") / toxic - F.col("c") / clean) / error).otherwise(0.0)
    best = words.where("c + t >= 2").select("word", F.abs(far).alias("far")).where("far >= 2").orderBy(F.desc("far"), "word").limit(candidates).collect()
    terms = sorted({t.encode() for line in identity_terms for t in line})
    names = sorted({bytes(r["word"]) for r in best} | set(terms))
    place = {w: i for i, w in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in batches:
            rows = []
            for name, body, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = body.as_py()
                pairs = sorted(([place[w] for w in sorted(a & known)], [place[w] for w in sorted(b & known)]) for a, b in swaps_of(body, counterparts(identity_terms, name)))
                rows.append((name, label, sorted(place[w] for w in features(word_set(body)) & known), [a for a, _ in pairs], [b for _, b in pairs]))
            ints = pa.list_(pa.int32())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), ints, pa.list_(ints), pa.list_(ints))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "label", "here", "lost", "won"])

    encoded = "doc_id bigint, label int, here array<int>, lost array<array<int>>, won array<array<int>>"
    rows = sample.select("doc_id", "body", "label").mapInArrow(encode, encoded).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["here"]))
    weights = fit_weights(
        [r["here"] for r in rows],
        np.array([r["label"] for r in rows], float),
        [(a, b) for r in rows for a, b in zip(r["lost"], r["won"], strict=True) if a or b],
        len(names),
        swap_penalty=swap_penalty,
        sparsity=sparsity,
    )
    return ToxicityModel({w: float(v) for w, v in zip(names, weights, strict=False) if v}, float(weights[-1]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, folds: int = 5, cut: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null texts are empty, empty texts have the score of the bias."""
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), model.column(text_of(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, cut: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, all columns."""
    return docs.where(model.column(text_of(text)) < cut)
