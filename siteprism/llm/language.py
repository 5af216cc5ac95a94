"""Language identification by a small convolutional network over bytes.

A text is cut into windows of WINDOW bytes, all of them.  Bytes are embedded,
filters of several widths slide over a window, the largest response of each
filter goes through one layer and a softmax; a text's language is the likeliest
by the mean log-probability of its windows.  The network is trained in numpy on
windows of a bounded sample of labelled rows.

After training, embedding and filters are folded into one table per byte of a
filter (a convolution over embedded bytes is a sum of such entries), so that
scoring is look-ups, sums and maxima over batches of windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteprism.llm.common import map_slices, raw, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 16, 12
#: Labelled rows per language and windows per row that training may see.
SAMPLE, SAMPLE_WINDOWS = 400, 4
UNKNOWN = "und"
#: Bytes are told apart as letters (lower case), bytes beyond ASCII, and one class for all else.
_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 100 if b >= 128 else 27 for b in range(256)], np.uint8)
CLASSES = 156  # 0 pads
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text as rows of byte classes; a run of bytes that are no letter counts once, the last row is padded."""
    codes = _CLASS[np.frombuffer(text, np.uint8)]
    other = codes == 27
    codes = codes[~(other & np.concatenate([[False], other[:-1]]))]
    rows = -(-len(codes) // size)
    out = np.zeros(rows * size, np.uint8)
    out[: len(codes)] = codes
    return out.reshape(rows, size)


def has_letter(text: bytes) -> bool:
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))) or _ASCII_LETTER.search(text) is not None


@dataclass(frozen=True)
class Network:
    langs: tuple[str, ...]
    embedding: np.ndarray  # (CLASSES, EMBEDDED)
    filters: tuple[np.ndarray, ...]  # (width, EMBEDDED, FILTERS) each
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS + 1, languages)

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray((self.embedding @ f[j]).astype(np.float32)) for j in range(len(f))] for f in self.filters]


def pooled(tables: list[list[np.ndarray]], windows: np.ndarray) -> np.ndarray:
    """The largest response of every filter in every window."""
    out = []
    for table in tables:
        width = len(table)
        n = windows.shape[1] - width + 1
        total = np.take(table[0], windows[:, :n], axis=0)
        for j in range(1, width):
            total += np.take(table[j], windows[:, j : j + n], axis=0)
        out.append(total.max(1))
    return np.concatenate(out, axis=1)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy; gradients flow through the places of the maxima."""
    rng = np.random.default_rng(seed)
    width_filters = [rng.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)) for w in WIDTHS]
    params = [rng.normal(0, 0.5, (CLASSES, EMBEDDED)), *width_filters, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(langs)))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            x, y = windows[order[a : a + batch]], target[order[a : a + batch]]
            grads = gradients(params, x, y)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(tuple(langs), params[0], tuple(params[1:-2]), params[-2], params[-1])


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    embedding, filters, bias, out = params[0], params[1:-2], params[-2], params[-1]
    n, rows = len(x), np.arange(len(x))[:, None]
    peaks, places = [], []
    for f in filters:
        table = [embedding @ f[j] for j in range(len(f))]
        total = sum(np.take(t, x[:, j : x.shape[1] - len(f) + 1 + j], axis=0) for j, t in enumerate(table))
        place = total.argmax(1)
        places.append(place)
        peaks.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
    hidden = np.maximum(np.concatenate(peaks, axis=1) + bias, 0)
    full = np.concatenate([hidden, np.ones((n, 1))], axis=1)
    error = np.exp(log_softmax(full @ out))
    error[np.arange(n), y] -= 1
    error /= n
    grad_out = full.T @ error
    back = (error @ out[:-1].T) * (hidden > 0)
    grad_embedding, grad_filters = np.zeros_like(embedding), []
    for i, (f, place) in enumerate(zip(filters, places)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        grad_f = np.zeros_like(f)
        for j in range(len(f)):
            seen = x[rows, place + j]
            grad_f[j] = np.einsum("nkd,nk->dk", embedding[seen], g)
            np.add.at(grad_embedding, seen, g[:, :, None] * f[j].T[None])
        grad_filters.append(grad_f)
    return [grad_embedding, *grad_filters, back.sum(0), grad_out]


def sample_windows(rows: DataFrame, per_row: int) -> DataFrame:
    """Up to `per_row` windows of a text, evenly spread over all of it."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            langs, found = [], []
            for lang, t in zip(part.column("lang").to_pylist(), raw(part.column("text"))):
                w = windows_of(t or b"")
                for i in range(0, len(w), max(1, -(-len(w) // per_row))):
                    langs.append(lang)
                    found.append(w[i].tobytes())
            return {"lang": pa.array(langs, pa.string()), "codes": pa.array(found, pa.binary())}

        return work

    return map_slices(rows, make, "lang string, codes binary")


def fit(labelled: DataFrame, sample: int = SAMPLE, per_row: int = SAMPLE_WINDOWS) -> Network:
    """Train on up to `sample` rows (doc_id, text, lang) per language, the first by hash of id; rows without id, text or lang don't count.

    The number of languages must be small (a network has an output for each).  No row: a network that knows no language.
    """
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    keys = rows.select("doc_id", "lang").distinct().withColumn("_rank", F.row_number().over(order))
    picked = rows.join(F.broadcast(keys.filter(F.col("_rank") <= sample).drop("_rank")), ["doc_id", "lang"])
    got = sorted(tuple(r) for r in sample_windows(picked.select("text", "lang"), per_row).collect())
    langs = sorted({x for x, _ in got})
    windows = np.array([np.frombuffer(c, np.uint8) for _, c in got], np.uint8).reshape(len(got), WINDOW)
    place = {x: i for i, x in enumerate(langs)}
    return train(windows, np.array([place[x] for x, _ in got], np.int64), langs)


class Scorer:
    def __init__(self, network: Network) -> None:
        self.network, self.tables = network, network.tables()

    def windows(self, windows: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Log-probabilities of the languages for every window."""
        n = self.network
        out = [np.zeros((0, len(n.langs)))]
        for a in range(0, len(windows), at_once):
            hidden = np.maximum(pooled(self.tables, windows[a : a + at_once]) + n.bias, 0)
            out.append(log_softmax(np.concatenate([hidden, np.ones((len(hidden), 1))], axis=1) @ n.out))
        return np.concatenate(out)

    def texts(self, batch: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, score) of every text; `und` and 0 without a letter, a text or a language."""
        found = [windows_of(t or b"") for t in batch]
        ends = np.cumsum([len(w) for w in found])
        logs = self.windows(np.concatenate(found)) if found and self.network.langs else None
        out = []
        for t, w, end in zip(batch, found, ends):
            if not self.network.langs or not has_letter(t or b""):
                out.append((UNKNOWN, 0.0))
                continue
            weight = (w != 0).sum(1)
            mean = (logs[end - len(w) : end] * weight[:, None]).sum(0) / weight.sum()
            p = np.exp(log_softmax(mean[None]))[0]
            out.append((self.network.langs[int(p.argmax())], float(p.max())))
        return out


def identify(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1, the mean over the text's windows of the likeliest language); a row per row.

    Texts that are NULL, empty or without a letter are `und` with score 0, as is everything under a network without
    languages.  Long texts are scored window by window, whole.  The first language by name wins a tie.  Repeated rows and ids
    are rows of their own; an empty table gives an empty one; other columns are left behind.
    """
    rows = texts(docs, doc_id, text)

    def make():
        scorer = Scorer(network)

        def work(part: pa.RecordBatch) -> dict:
            found = scorer.texts(raw(part.column("text")))
            return {"doc_id": part.column("doc_id"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}

        return work

    return map_slices(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
