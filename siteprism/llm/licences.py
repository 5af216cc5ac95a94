"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is compared in units: the whole of it, each of its lines and each of its
paragraphs (runs of lines that hold a word).  Normalised are case (A-Z),
punctuation (everything but digits, a-z and what lies beyond ASCII separates
words) and the spelling licence.  A unit and a template are the sets of their
distinct word bigrams (a single word is a set of itself); Dice is twice the
common bigrams over the sum of both sizes.

Dice >= t holds only if the sizes differ by a factor of (2 - t) / t at most, so
a unit meets only the templates of such sizes, and a unit shorter or longer
than all of them isn't even split into bigrams.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteprism.llm.common import map_slices, raw, texts

#: Least Dice coefficient in hundredths, so that all comparisons are of integers.
THRESHOLD = 90
_SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 10 if b == 10 else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """Normalised text; line ends stay."""
    return text.lower().translate(_SPACED).replace(b"licence", b"license")


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


class Passages:
    """The bigrams of a text's words by place: where each was met before, and where it comes next."""

    def __init__(self, words: list[bytes]) -> None:
        self.grams = list(zip(words, words[1:]))
        self.distinct = frozenset(self.grams)
        self.before: list[int] | None = None

    def places(self) -> None:
        n = len(self.grams)
        self.before, self.after = [-1] * n, [n] * n
        last: dict = {}
        for i, g in enumerate(self.grams):
            j = last.get(g, -1)
            self.before[i] = j
            if j >= 0:
                self.after[j] = i
            last[g] = i
        self.met = np.array(self.before, np.int64)

    def best(self, passage: frozenset, least: int, most: int) -> tuple[int, int] | None:
        """(common, sum of sizes) of the run of words with the highest coefficient among those of `most` distinct bigrams or fewer.

        least: distinct bigrams of the passage that a run must hold.  `end` is as far as a run from `start` may reach; a
        run that meets its first bigram again is no better without the first, so runs end there, and all of them
        together are read once for each bigram of the passage at most.
        """
        if len(passage & self.distinct) < least:
            return None
        if self.before is None:
            self.places()
        grams, before, after = self.grams, self.before, self.after
        hits = [g in passage for g in grams]
        known = np.array(hits, bool)
        best, size, common, end, n = None, 0, 0, 0, len(grams)
        for start in range(n):
            while end < n and (size < most or before[end] >= start):
                if before[end] < start:
                    size += 1
                    common += hits[end]
                end += 1
            if hits[start] and common >= least and (best is None or common * best[1] > best[0] * (len(passage) + common)):
                stop = min(end, after[start])
                new = self.met[start:stop] < start
                held = np.cumsum(new & known[start:stop])
                total = np.cumsum(new) + len(passage)
                k = int(np.argmax(held / total))
                c, t = int(held[k]), int(total[k])
                if best is None or c * best[1] > best[0] * t:
                    best = (c, t)
            if after[start] >= end:
                size -= 1
                common -= hits[start]
        return best


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: int = THRESHOLD, passages: list[tuple[str, str]] = ()) -> None:
        """templates: (licence, text); those without a word match nothing.  passages: templates looked for in all runs of words too."""
        sets = [(bigrams(normalised(t.encode()).split()), name) for name, t in templates]
        self.templates = sorted(((s, n) for s, n in sets if s), key=lambda x: (len(x[0]), x[1]))
        self.sizes = [len(s) for s, _ in self.templates]
        self.threshold = threshold
        self.least, self.most = (self.bounds(self.sizes[0])[0], self.bounds(self.sizes[-1])[1]) if self.sizes else (1, 0)
        self.vocabulary = frozenset(w for s, _ in self.templates for b in s for w in (b if isinstance(b, tuple) else (b,)))
        self.passages = []
        for name, t in passages:
            words = normalised(t.encode()).split()
            grams = bigrams(words)
            if len(words) > 1:
                low, high = self.bounds(len(grams))
                # a missing word takes a bigram with it, and a missing bigram two words at most
                self.passages.append((grams, frozenset(words), low, high, len(set(words)) - 2 * (len(grams) - low), name))
        self.passage_words = frozenset(w for p in self.passages for w in p[1])

    def bounds(self, size: int) -> tuple[int, int]:
        """Sizes of sets that can reach the threshold against one of `size`."""
        t = self.threshold
        return -(-size * t // (200 - t)), size * (200 - t) // t

    def unit(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(common, sum of sizes, licence) of all templates that reach the threshold."""
        most_known = len(words) - 1 if len(words) > 1 else len(words)
        if most_known < self.least:
            return []
        known = self.vocabulary.intersection(words)
        if not known:
            return []
        grams = bigrams(words)
        size = len(grams)
        if size > self.most:
            return []
        low, high = self.bounds(size)
        out = []
        for i in range(bisect_left(self.sizes, low), bisect_right(self.sizes, high)):
            template, name = self.templates[i]
            common, total = len(template & grams), len(template) + size
            if 200 * common >= self.threshold * total:
                out.append((common, total, name))
        return out

    def text(self, text: bytes) -> list[tuple[int, int, str]]:
        """Matches of all units; a unit's words met before (a paragraph of one line, say) count once."""
        lines = [x.split() for x in normalised(text).split(b"\n")]
        units: list[list[bytes]] = [x for x in lines if x]
        paragraph: list[list[bytes]] = []
        for line in [*lines, []]:
            if line:
                paragraph.append(line)
            else:
                if len(paragraph) > 1 and sum(map(len, paragraph)) - 1 >= self.least:
                    units.append([w for x in paragraph for w in x])
                paragraph = []
        whole = [w for x in lines for w in x]
        units.append(whole)
        return [m for u in units if u for m in self.unit(u)] + self.anywhere(whole)

    def anywhere(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(common, sum of sizes, licence) of the best run of words of each passage that reaches the threshold."""
        known = self.passage_words.intersection(words)
        out, text = [], None
        for grams, own, low, high, least_words, name in self.passages:
            if known and len(words) > low and len(own & known) >= least_words:
                text = text or Passages(words)
                found = text.best(grams, low, high)
                if found and 200 * found[0] >= self.threshold * found[1]:
                    out.append((*found, name))
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]], threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text", passages: list[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, licence (of the best match; at equal coefficients the first by name), score, licences (all found, sorted), a row per row.

    Without a match, with NULL and with empty texts: licence and score NULL, licences empty.  Other columns are left behind.
    passages: templates that are looked for in all runs of a text's words too.
    """
    rows = texts(docs, doc_id, text)

    def make():
        scanner = Scanner(templates, threshold, passages)

        def work(part: pa.RecordBatch) -> dict:
            best, scores, names = [], [], []
            for t in raw(part.column("text")):
                found = scanner.text(t or b"")
                top = min(found, key=lambda m: (-m[0] / m[1], m[2]), default=None)
                best.append(top and top[2])
                scores.append(top and 2 * top[0] / top[1])
                names.append(sorted({m[2] for m in found}))
            return {"doc_id": part.column("doc_id"), "licence": pa.array(best, pa.string()), "score": pa.array(scores, pa.float64()), "licences": pa.array(names, pa.list_(pa.string()))}

        return work

    return map_slices(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, licence string, score double, licences array<string>")
