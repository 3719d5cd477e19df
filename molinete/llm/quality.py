"""Quality: Bradley-Terry scores learned from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import held_out, text_of
from molinete.llm.labelled import SAMPLE_ROWS, training_sample

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, [32, 9, 10, 11, 12, 13]),
        np.isin(_BYTES, [44, 46]),
        np.isin(_BYTES, [33, 63]),
        np.isin(_BYTES, list(b"#$%&*+<=>@\\^_`{|}~/")),
    ]
).astype(float)

#: What is measured of a text, in this order.
FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digits", "space", "stops", "shouts", "signs", "mean_word", "long_words", "distinct_words", "top_word",
    "distinct_pairs", "top_pair", "repeats_next", "log_lines", "distinct_lines", "mean_line", "words_without_letters", "one_letter_words", "shout_words", "sign_words",
)


def measures(text: str) -> np.ndarray:
    """The :data:`FEATURES` of a whole text; an empty text has zeros throughout."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    words = raw.split()
    if not words:
        return out
    n = len(words)
    kinds = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    tally, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    lengths = [len(w) for w in words]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    bare = sum(c for w, c in tally.items() if not w.upper() != w.lower() and w.isascii())
    shout = sum(c for w, c in tally.items() if len(w) > 2 and w.isupper())
    signs = sum(c for w, c in tally.items() if w[-1:] in b"#$%&*+<=>@\\^_`{|}~/" and len(w) > 1)
    out[:] = [
        np.log1p(len(raw)), np.log1p(n), *kinds, sum(lengths) / n, sum(x > 20 for x in lengths) / n, len(tally) / n, max(tally.values()) / n,
        len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1), sum(map(bytes.__eq__, words, words[1:])) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), bare / n, sum(x == 1 for x in lengths) / n, shout / n, signs / n,
    ]
    return out


@dataclass
class QualityModel:
    """A weight per step of each measure; ``shift`` puts the score quantile at which documents are accepted on ``cut``."""

    edges: list[np.ndarray]
    weights: np.ndarray
    shift: float

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """One column for each edge of each measure: whether the measure reaches it."""
        return np.concatenate([rows[:, [i]] >= e[None, :] for i, e in enumerate(self.edges)], axis=1).astype(float)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steps(rows) @ self.weights + self.shift, -30, 30)))

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            rows = np.array([measures(t) for t in texts]).reshape(-1, len(FEATURES))
            return pd.Series(model.score(rows))

        return scored(text)


def fit_pairs(better: np.ndarray, worse: np.ndarray, *, penalty: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Bradley-Terry weights: the mean of log(1 + exp(-w.(better - worse))) plus ``penalty`` |w|^2 / 2, by Newton steps."""
    x, w = better - worse, np.zeros(better.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        slope = penalty * w - x.T @ p / len(x)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, edges: int = 10, pairs: int = 20_000, sample_rows: int = SAMPLE_ROWS, folds: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> QualityModel:
    """A :class:`QualityModel` from the ``quality`` labels outside the held-out fold.

    Measures of at most ``sample_rows`` labelled documents are cut into steps at their quantiles. Each of ``pairs`` preference pairs joins a
    document of quality 1 with one of quality 0; the weights follow from logistic loss on the differences of their steps. The
    threshold is a quantile of the sample's scores, the one that best separates the labels (half way to the next score); it is
    put on ``cut``. Without labels of both kinds every document scores the share of good labels.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(body.as_py()).tolist() for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "m"])

    sample = training_sample(docs, labels, "quality", rows=sample_rows, folds=folds, doc_id=doc_id, text=text)
    found = sorted(sample.select("doc_id", "body", "label").mapInArrow(measure, "doc_id bigint, label int, m array<double>").collect(), key=lambda r: (r["doc_id"], r["m"]))
    y = np.array([r["label"] for r in found], int)
    rows = np.array([r["m"] for r in found]).reshape(-1, len(FEATURES))
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 1.0
        return QualityModel([np.zeros(0)] * len(FEATURES), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # Quantiles of either label, so that a rare kind of document has steps of its own.
    grid = np.linspace(0, 1, edges + 2)[1:-1]
    marks = [np.unique(np.concatenate([np.quantile(rows[y == k, i], grid) for k in (0, 1)])) for i in range(rows.shape[1])]
    model = QualityModel(marks, np.zeros(0), 0.0)
    steps, rng = model.steps(rows), np.random.default_rng(0)
    high, low = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model.weights = fit_pairs(steps[rng.choice(high, pairs)], steps[low[np.arange(pairs) % len(low)]])
    scores = steps @ model.weights
    order = np.argsort(scores, kind="stable")
    # Accepting everything from place k of the order on: good ones kept and bad ones dropped, each as a share.
    kept = 1 - np.concatenate([[0], np.cumsum(y[order] == 1)]) / len(high)
    dropped = np.concatenate([[0], np.cumsum(y[order] == 0)]) / len(low)
    ends = np.concatenate([[scores[order[0]] - 1], scores[order], [scores[order[-1]] + 1]])
    gain = np.where(ends[1:] > ends[:-1], kept + dropped, -1)
    k = int(np.argmax(gain))
    model.shift = float(np.log(cut / (1 - cut)) - (ends[k] + ends[k + 1]) / 2)
    return model


def quality_scores(docs: DataFrame, model: QualityModel, *, folds: int = 5, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; a null text is empty, an empty one is measured as zeros."""
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), model.column(text_of(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
