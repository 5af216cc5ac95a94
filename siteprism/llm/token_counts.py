"""Token counts by a Viterbi pass that carries a score and a count, no path.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each
place of a unit; dynamic programming keeps the best score up to there and the
number of pieces on the way.  Ties go as in the tokenizer: at equal scores the
piece that starts first (the longest) stays.  A character without a piece of
its own costs the lowest score less 10 and counts as its UTF-8 bytes where the
vocabulary has byte pieces; else a run of them, over units too, counts as one.

Scores are summed in double precision, which is exact for integral scores; the
tokenizer's own single precision loses exactness in texts of very many pieces.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from siteprism.llm.common import map_slices, texts
from siteprism.llm.vocabulary import Vocabulary

UNKNOWN_PENALTY = 10.0
#: Units remembered in a task before the memory is emptied, and their longest length.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.auto = ahocorasick.Automaton()
        for piece, i in vocabulary.id_of.items():
            self.auto.add_word(piece, (len(piece), vocabulary.scores[i]))
        self.auto.make_automaton()
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.id_of.values()) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float, bool, bool]] = {}

    def unit(self, text: str) -> tuple[int, float, bool, bool]:
        """(pieces, score) of the best segmentation of one unit, and whether it begins and ends with a run of unknown characters."""
        n, runs = len(text), not self.vocabulary.bytes_of
        head, tail = [False] * (n + 1), [False] * (n + 1)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, found in self.auto.iter(text):
            ends[last].append(found)
        for last, found in enumerate(ends):
            top, pieces, begins = None, 0, False
            single = False
            for length, score in sorted(found, reverse=True):
                single = single or length == 1
                start = last + 1 - length
                total = best[start] + score
                if top is None or total > top:
                    top, pieces, begins = total, count[start] + 1, head[start]
            if not single:
                total = best[last] + self.unknown
                if top is None or total > top:
                    top, begins = total, runs and (head[last] or last == 0)
                    pieces = count[last] + (not tail[last] if runs else len(text[last].encode()))
                    tail[last + 1] = runs
            best[last + 1], count[last + 1], head[last + 1] = top, pieces, begins
        return count[n], best[n], head[n], tail[n]

    def text(self, text: str) -> tuple[int, float]:
        pieces, score, open_run = 0, 0.0, False
        known = self.known
        for unit in self.vocabulary.split(text):
            got = known.get(unit)
            if got is None:
                got = self.unit(unit)
                if len(unit) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[unit] = got
            pieces += got[0] - (open_run and got[2])
            score += got[1]
            open_run = got[3]
        return pieces, score


def token_counts(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation, 0 without a piece); a row per row.

    NULL and the empty text have no tokens.  Repeated rows and ids are rows of their own, texts of any length are counted
    whole, an empty table gives an empty one.  Other columns are left behind.
    """
    rows = texts(docs, doc_id, text)

    def make():
        counter = Counter(vocabulary)

        def work(part: pa.RecordBatch) -> dict:
            found = [counter.text(t or "") for t in part.column("text").to_pylist()]
            return {"doc_id": part.column("doc_id"), "n_tokens": pa.array([n for n, _ in found], pa.int64()), "score": pa.array([s for _, s in found], pa.float64())}

        return work

    return map_slices(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, score double")
