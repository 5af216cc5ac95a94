"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

One pass measures every whole text.  Each rule turns the measures into a vote:
1 (good), -1 (poor) or 0 (abstains).  Votes are treated as independent given
the unknown class, each rule with its own chance of voting on either class,
that is, its own accuracy.  Expectation-maximisation fits these and the share
of good texts to the counts of all vote patterns of rows that pass the base
(at most 2 to the number of rules, summed up by Spark over all rows), with no
label.  The posterior probability
of "good" replaces a filter that all rules must pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import checkpointed, map_slices, raw, texts

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _UPPER + bytes(range(97, 123))
_CONTINUATION = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_ended_lines"]


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text; all 0 for NULL and for the empty text.

    word_chars and n_letters count code points; every code point beyond ASCII counts as a letter.
    """
    text = text or b""
    words = text.split()
    points = len(text.translate(None, _CONTINUATION))
    white = len(text) - len(text.translate(None, _WHITE))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ascii_letters = len(text) - len(text.translate(None, _ASCII_LETTERS))
    beyond = len(text.translate(None, bytes(range(128)) + _CONTINUATION))
    return (
        len(words),
        points - white,
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        ascii_letters + beyond,
        text.count(b"!") + text.count(b"?"),
        sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines),
    )


def repeated_words(words: list[bytes], n: int = REPEAT_WINDOW) -> int:
    """Words inside an n-word window that the text holds twice or more (its first occurrence included)."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple[bytes, ...], int] = {}
    starts: set[int] = set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j < i:
            starts.update((i, j))
    total = end = 0
    for i in sorted(starts):
        total += i + n - max(i, end)
        end = i + n
    return total


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with MEASURES as longs, a row per row."""
    rows = texts(docs, doc_id, text)

    def make():
        def work(part: pa.RecordBatch) -> dict:
            columns = zip(*[measure(t) for t in raw(part.column("text"))])
            return {"doc_id": part.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in zip(MEASURES, columns)}

        return work

    kind = dict(rows.dtypes)["doc_id"]
    return map_slices(rows, make, ", ".join([f"doc_id {kind}", *[f"{m} long" for m in MEASURES]]))


@dataclass(frozen=True)
class Rule:
    """Votes `vote` (1 good, -1 poor) where `when` holds and abstains (0) elsewhere."""

    name: str
    vote: int
    when: Callable[[], Column]

    def column(self) -> Column:
        return F.when(self.when(), self.vote).otherwise(0)


def _c(name: str) -> Column:
    return F.col(name)


RULES = [
    Rule("odd_words", -1, lambda: (_c("word_chars") < 2.5 * _c("n_words")) | (_c("word_chars") > 12 * _c("n_words"))),
    Rule("symbols", -1, lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("repeats", -1, lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
    Rule("dup_lines", -1, lambda: 10 * _c("n_dup_lines") > 3 * _c("n_lines")),
    Rule("capitals", -1, lambda: 10 * _c("n_upper") > 3 * _c("n_letters")),
    Rule("few_letters", -1, lambda: 10 * _c("n_letters") < 8 * _c("word_chars")),
    Rule("marks", -1, lambda: 10 * _c("n_marks") > 2 * _c("n_words")),
    Rule("sentences", 1, lambda: 10 * _c("n_ended_lines") >= 6 * _c("n_lines")),
    Rule("varied", 1, lambda: (100 * _c("n_repeat_words") <= 5 * _c("n_words")) & (_c("n_words") >= MIN_WORDS)),
    Rule("plain", 1, lambda: (100 * _c("n_letters") >= 93 * _c("word_chars")) & (10 * _c("n_upper") <= _c("n_letters")) & (_c("n_symbols") == 0)),
]


@dataclass(frozen=True)
class Model:
    """The share of good texts, and each rule's chance of voting on a poor and on a good text."""

    good: float
    chances: list[tuple[float, float]]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log-odds of good: where all abstain, and what each rule's vote adds to that (alone, per rule)."""
        silent = [math.log((1 - g) / (1 - p)) for p, g in self.chances]
        return math.log(self.good / (1 - self.good)) + sum(silent), [math.log(g / p) - x for (p, g), x in zip(self.chances, silent)]

    def accuracy(self, votes: list[int]) -> list[float]:
        """How often each rule is right when it votes."""
        out = []
        for v, (p, g) in zip(votes, self.chances):
            good, poor = g * self.good, p * (1 - self.good)
            out.append((good if v > 0 else poor) / (good + poor))
        return out


def fit(patterns: list[tuple[tuple[int, ...], int]], sides: list[int], rounds: int = 500, odds: float = 8.0, good: float = 0.8, prior: float = 0.001) -> Model:
    """EM over counted vote patterns; sides: what each rule votes when it doesn't abstain.

    Starts with every rule `odds` times as likely to vote on a text of its own side; made-up rows of that kind, `prior`
    of all rows (1 at least), tell the two classes apart and keep every chance inside 0 and 1.  No patterns: the start.
    """
    total = sum(n for _, n in patterns)
    weight = max(1.0, prior * total)
    start = []
    for j, side in enumerate(sides):
        rate = (sum(n for v, n in patterns if v[j]) + 0.5) / (total + 1)
        share = good if side > 0 else 1 - good
        own = min(0.95, rate / (share + (1 - share) / odds))
        start.append((own / odds, own) if side > 0 else (own, own / odds))
    model = Model(good, start)
    for _ in range(rounds):
        base, weights = model.weights()
        in_poor, in_good = (1 - good) * weight, good * weight
        votes_poor, votes_good = [c[0] * in_poor for c in start], [c[1] * in_good for c in start]
        for votes, n in patterns:
            z = base + sum(w for w, v in zip(weights, votes) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            in_good, in_poor = in_good + p * n, in_poor + (1 - p) * n
            for j, v in enumerate(votes):
                if v:
                    votes_good[j] += p * n
                    votes_poor[j] += (1 - p) * n
        after = Model(in_good / (in_good + in_poor), [(a / in_poor, b / in_good) for a, b in zip(votes_poor, votes_good)])
        done = abs(after.good - model.good) < 1e-10
        model = after
        if done:
            break
    return model


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base measures, base_failed, posterior (of good) and kept; a row per row of any text.

    NULL and empty texts have no words and so fail the base; an empty table gives an empty result.  The measures (ten
    numbers a row, no text) are checkpointed, as the votes are counted before they are judged.
    """
    names = [f"vote_{r.name}" for r in rules]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = checkpointed(measures(docs, doc_id, text)).withColumns({"base_failed": failed} | {n: r.column() for n, r in zip(names, rules)})
    counted = rows.filter(~F.col("base_failed")).groupBy(*names).count().select(*names, "count").collect()
    base, weights = fit(sorted((tuple(r[:-1]), r[-1]) for r in counted), [r.vote for r in rules]).weights()
    z = sum((F.when(F.col(n) != 0, w).otherwise(0.0) for n, w in zip(names, weights)), F.lit(base))
    out = rows.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", *MEASURES[:5], "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"))
