"""Severity of toxicity by cumulative-link (proportional odds) regression.

The chance that a text's grade is at most k is sigmoid(threshold_k - w.x): one
weight per feature shared by all ordered thresholds.  Features are whole words
and the first 4 to 8 bytes of words (inflected forms share a stem); x is 1 +
log(count) of the features that a text holds.  Training labels say only yes or
no, so grades above 0 come from how many features typical of toxic rows a toxic
row holds (its third of the toxic rows that hold any; rows without one get
grade 1).

Features and weights are learned on a bounded sample of labelled rows (`sample`
rows of either label, chosen by the hash of their id); every text is scored
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import carried, handed_on, map_slices, raw, texts

GRADES = 4
SAMPLE = 4000
VOCABULARY = 2048
MIN_DOCS = 4
#: A feature counts if its chi-square against the label is as high; below, chance picks some of a million words.
MIN_CHI = 20.0
PREFIXES = range(4, 9)
HEAD = PREFIXES[0]
_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of a-z and of everything beyond ASCII."""
    return _LETTERS.sub(b" ", (text or b"").lower()).split()


def features_of(words: list[bytes]) -> Counter:
    """Counts of whole words (ended with $) and of their first bytes."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w + b"$"] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            out[w[:k]] += n
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]  # of features with a weight other than 0
    thresholds: tuple[float, ...]

    def heads(self) -> frozenset[bytes]:
        """First bytes of the words that can hold a feature."""
        return frozenset(f.rstrip(b"$")[:HEAD] for f in self.weights)

    def score(self, words: list[bytes]) -> float:
        return float(sum(self.weights[f] * (1 + np.log(n)) for f, n in features_of(words).items() if f in self.weights))

    def beyond(self, score: np.ndarray) -> np.ndarray:
        """The chances of a grade of 1, 2, ... at least; a row per score."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(score)[:, None], -500, 500)))


def chosen(docs: DataFrame, labels: DataFrame, sample: int, label: str) -> DataFrame:
    """Up to `sample` labelled rows of either label as (doc_id, text, toxic); a row labelled both ways counts as toxic.

    Rows without an id or a label are left out.  Only the chosen ids (2 * sample at most) are joined to the texts.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = [known.filter(F.col("toxic") == v).orderBy(order, "doc_id").limit(sample) for v in (0, 1)]
    return texts(docs).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")


def _bags(rows: DataFrame, keep: frozenset[bytes] | None = None) -> DataFrame:
    """doc_id, toxic, words, counts of the text's words (those in `keep`)."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            words, counts = [], []
            for t in raw(part.column("text")):
                bag = features_of(words_of(t))
                if keep is not None:
                    bag = {w: n for w, n in bag.items() if w in keep}
                words.append(list(bag))
                counts.append(list(bag.values()))
            return {"toxic": part.column("toxic"), "words": pa.array(words, pa.list_(pa.binary())), "counts": pa.array(counts, pa.list_(pa.int32()))}

        return work

    return map_slices(rows, make, "toxic int, words array<binary>, counts array<int>")


def vocabulary(rows: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> list[tuple[bytes, float]]:
    """Up to `size` words of the rows with the largest chi-square against the label, and their log-odds of toxic.

    Counted by Spark (a row per word and label); only the chosen words come to the driver.
    """
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    seen = _bags(rows).select("toxic", F.explode("words").alias("word")).groupBy("word")
    found = seen.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") + F.col("b") >= min_docs)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / (n0 * n1) / ((a + b) * (n0 + n1 - a - b) + 0.5)
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    return [(bytes(r["word"]), r["odds"]) for r in found.select("word", chi.alias("chi"), odds.alias("odds")).filter(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "word").limit(size).collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, size: int = VOCABULARY, typical: float = 2.5, penalty: float = 0.00005, rounds: int = 2000) -> Model:
    """Fit on the sample.  Without rows of both labels the model knows no word and calls nothing toxic."""
    rows = chosen(docs, labels, sample, label).persist()
    try:
        words = vocabulary(rows, size)
        got = _bags(rows, frozenset(w for w, _ in words)).collect() if words else []
    finally:
        rows.unpersist()
    if not words:
        return Model({}, tuple(20.0 + k for k in range(GRADES - 1)))
    place = {w: i for i, (w, _) in enumerate(words)}
    telling = {w for w, o in words if o >= typical}
    got.sort(key=lambda r: (r["toxic"], sorted(map(bytes, r["words"])), r["counts"]))
    toxic = np.array([r["toxic"] for r in got])
    hits = np.array([sum(n for w, n in zip(r["words"], r["counts"]) if bytes(w) in telling) for r in got])
    held = hits[(toxic == 1) & (hits > 0)]
    cuts = np.quantile(held, [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if len(held) else np.zeros(GRADES - 2)
    grade = np.where(toxic == 1, 1 + (hits[:, None] > cuts[None, :]).sum(1), 0)
    at = np.repeat(np.arange(len(got)), [len(r["words"]) for r in got])
    column = np.array([place[bytes(w)] for r in got for w in r["words"]], np.int64)
    value = 1 + np.log(np.array([n for r in got for n in r["counts"]], np.float64))
    weights, thresholds = descend(at, column, value, grade, len(words), penalty, rounds)
    return Model({w: float(weights[i]) for w, i in place.items() if weights[i]}, tuple(thresholds))


def descend(at: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, penalty: float, rounds: int) -> tuple[np.ndarray, list[float]]:
    """Accelerated proximal gradient for the mean log-loss plus `penalty` times the weights' absolute sum.

    Thresholds are a first one and positive steps, so they stay ordered.  Each coordinate has a step from the bound of
    its own curvature.
    """
    n, k = len(grade), GRADES - 1
    w, ahead = np.zeros(size), np.zeros(size)
    base = [np.log((np.mean(grade <= j) + 1e-3) / (np.mean(grade > j) + 1e-3)) for j in range(k)]
    t = np.array([base[0], *np.log(np.maximum(np.diff(base), 1e-2))])
    step = 4.0 / max(1e-9, np.bincount(at, value**2, n).max()) * 4.0
    momentum = 1.0
    loss_before = np.inf
    for _ in range(rounds):
        cut = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        score = np.bincount(at, ahead[column] * value, n)
        z = np.clip(cut[None, :] - score[:, None], -30, 30)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-z)), np.ones((n, 1))], axis=1)
        p = np.maximum(below[np.arange(n), grade + 1] - below[np.arange(n), grade], 1e-12)
        slope = below * (1 - below)
        up, down = slope[np.arange(n), grade + 1], slope[np.arange(n), grade]
        by_score = (up - down) / p  # derivative of the loss by the score
        grad_cut = np.zeros(k)
        for j in range(k):
            grad_cut[j] = -(np.where(grade == j, up, 0) - np.where(grade == j + 1, down, 0)).dot(1 / p) / n
        grad_t = np.array([grad_cut.sum(), *(np.exp(t[j]) * grad_cut[j:].sum() for j in range(1, k))])
        grad = np.bincount(column, by_score[at] * value, size) / n
        loss = -np.log(p).mean() + penalty * np.abs(ahead).sum()
        if loss > loss_before + 1e-3:
            step, momentum = step / 2, 1.0
        loss_before = loss
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
        t -= 0.5 * grad_t
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])).tolist()


def severity(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES - 1), grade (the likeliest), p_toxic (chance of a grade above 0), toxic.

    A row per row; NULL and empty texts score as texts without a known word.  Other columns are left behind, or come along
    in `row` (carry).
    """
    rows = texts(docs, doc_id, text, carry)

    def make():
        heads = model.heads()

        def work(part: pa.RecordBatch) -> dict:
            scores = []
            for t in raw(part.column("text")):
                scores.append(model.score([w for w in words_of(t) if w[:HEAD] in heads]))
            beyond = model.beyond(np.array(scores, np.float64))
            ends = np.concatenate([np.ones((len(scores), 1)), beyond, np.zeros((len(scores), 1))], axis=1)
            return handed_on(part) | {"severity": pa.array(beyond.sum(1)), "grade": pa.array((ends[:, :-1] - ends[:, 1:]).argmax(1).astype(np.int32)), "p_toxic": pa.array(beyond[:, 0])}

        return work

    return map_slices(rows, make, f"{carried(rows)}, severity double, grade int, p_toxic double").withColumn("toxic", F.col("p_toxic") >= threshold)
