"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are plain statistics of the line and of the lines before and after it; the chain
adds how labels follow each other. Marginals of the forward-backward pass, weighted by line length, are the document's
score. The field is fitted on a bounded sample of labelled documents (``TRAIN_DOCS`` documents of at most ``TRAIN_LINES``
lines, chosen by a hash of the id), whose lines take their document's label; scoring covers whole texts of all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, remainder

TRAIN_DOCS, TRAIN_LINES = 6000, 400
ROUNDS, RATE, SHRINK = 250, 0.05, 1e-3
CUT = 0.3
_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS, _STOPS, _MARKS = b"#*$%&|<>{}[]\\^~_=+@", b".!?:;", b"!?"
BASE = 17


def _rate(line: bytes, chars: bytes) -> float:
    return (len(line) - len(line.translate(None, chars))) / len(line)


def line_features(line: bytes, seen: bool) -> list[float]:
    """Statistics of one line, each of about unit size. An empty line is all zeros but the constant and its mark."""
    words = line.split()
    n = len(words)
    if not n:
        return [1.0, 1.0] + [0.0] * (BASE - 2)
    different = len(set(words))
    stop = line.rstrip()[-1:]
    return [
        1.0, 0.0, math.log1p(n) / 4, math.log(len(line) / n) - 1.7, different / n, (n - different) / (10 + n), float(seen),
        min(1.0, 5 * _rate(line, _SYMBOLS)), 5 * _rate(line, _DIGITS), _rate(line, _UPPER), _rate(line, _LOWER), min(1.0, 10 * _rate(line, _MARKS)),
        float(stop in b".!?"), float(stop in b",:;|"), float(line[:1].isupper()), min(1.0, line.count(b"|") / n), min(1.0, 3 * sum(w[-1:] in b".!?;:" for w in words) / n),
    ]


def document_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features with both neighbours') and line lengths; lines without words are passed over."""
    seen: set[bytes] = set()
    rows, sizes = [], []
    for line in data.split(b"\n"):
        if line and not line.isspace():
            rows.append(line_features(line, line in seen))
            sizes.append(len(line))
            seen.add(line)
    if not rows:
        rows, sizes = [line_features(b"", False)], [1]
    own = np.array(rows, np.float32)
    edge = np.zeros((1, BASE), np.float32)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]), np.array(sizes, np.float64)


def forward_backward(unary: np.ndarray, lengths: np.ndarray, link: np.ndarray):
    """Log partition and state log-marginals of chains stored one after another, and expected transitions.

    ``unary``: (all lines, 2). Chains advance together, longest first, so a step works on all chains still running.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]  # chains longer than t
    ahead, back = np.array(unary), np.zeros_like(unary)
    for t in range(1, len(running)):
        now = starts[: running[t]] + t
        ahead[now] += np.logaddexp(ahead[now - 1, :1] + link[0], ahead[now - 1, 1:] + link[1])
    for t in range(len(running) - 1, 0, -1):
        now = starts[: running[t]] + t
        right = unary[now] + back[now]
        back[now - 1] = np.logaddexp(right[:, :1] + link[:, 0], right[:, 1:] + link[:, 1])
    ends = starts + lengths - 1
    total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    chain = np.empty(len(unary))
    for t in range(len(running)):
        chain[starts[: running[t]] + t] = total[: running[t]]
    inner = np.concatenate([starts[: running[t]] + t for t in range(1, len(running))] or [np.zeros(0, np.int64)])
    pairs = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(ahead[inner - 1, i] + link[i, j] + unary[inner, j] + back[inner, j] - chain[inner]).sum()
    return total.sum(), ahead + back - chain[:, None], pairs, inner


def train(documents: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, link): Adam steps over the whole sample along the likelihood's gradient, with a quadratic penalty.

    The gradient of the weights counts every document once, that of the links every line once, so the two are not of one
    likelihood. All lines of a document take its label. Without documents of both labels the weights are zero and every score is one half.
    """
    labels = [y for _, y in documents]
    if len(set(labels)) < 2:
        return np.zeros(3 * BASE), np.zeros((2, 2))
    x = np.vstack([f for f, _ in documents]).astype(np.float64)
    lengths = np.array([len(f) for f, _ in documents])
    y = np.repeat(labels, lengths)
    share = 1.0 / np.repeat(lengths, lengths)  # a document counts once, however many lines it has
    theta, m, v = np.zeros(3 * BASE + 4), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        w, link = theta[:-4], theta[-4:].reshape(2, 2)
        unary = np.stack([np.zeros(len(x)), x @ w], axis=1)
        _, marginal, pairs, inner = forward_backward(unary, lengths, link)
        gradient = x.T @ ((y - np.exp(marginal[:, 1])) * share)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1], y[inner]), 1.0)
        both = np.concatenate([gradient / len(documents), ((seen - pairs) / len(x)).ravel()]) - SHRINK * theta
        m, v = 0.9 * m + 0.1 * both, 0.999 * v + 0.001 * both**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def score_texts(texts: list[bytes], weights: np.ndarray, link: np.ndarray) -> list[float]:
    """Length-weighted mean probability of a good line, document by document, in blocks of bounded size."""
    scores, held, sizes, lines = [], [], [], 0

    def flush():
        if held:
            _, marginal, _, _ = forward_backward(np.vstack(held), np.array([len(h) for h in held]), link)
            good, at = np.exp(marginal[:, 1]), 0
            for size in sizes:
                part = good[at : at + len(size)]
                at += len(size)
                scores.append(float(np.clip((part * size).sum() / size.sum(), 0.0, 1.0)))
            held.clear()
            sizes.clear()

    for data in texts:
        features, size = document_features(data)
        unary = features @ weights
        held.append(np.stack([np.zeros(len(unary)), unary], axis=1))
        sizes.append(size)
        lines += len(size)
        if lines > 50_000:
            flush()
            lines = 0
    flush()
    return scores


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on labelled documents that satisfy ``usable`` (a condition on doc_id).

    A document labelled twice takes its lower label; null labels are passed over.
    """
    marks = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most TRAIN_DOCS rows of two numbers

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([f.tobytes() if len(f := document_features(t)[0]) <= TRAIN_LINES else None for t in texts])

    sample = docs.select("doc_id", binary("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", features("text").alias("f"))
    sample = sample.where("f IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return train([(np.frombuffer(r["f"], np.float32).reshape(-1, 3 * BASE), r["quality"]) for r in rows])


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts are one empty line and get the score of such. Null ids count as held out. Only the text is an
    input of a score; other columns are ignored. An empty table gives no rows.
    """
    weights, link = fit(docs, labels, remainder("doc_id", folds) != held)

    @F.pandas_udf("double")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(list(texts), weights, link), dtype="float64")

    scored = docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), of_texts(binary("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
