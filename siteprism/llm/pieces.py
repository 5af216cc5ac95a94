"""SentencePiece encoding through suffix arrays, and decoding.

The distinct units of a batch that are not yet known are joined to one text.
Its suffix array (cut at the longest piece's length) is searched for every
piece of the vocabulary at once; the range of suffixes that start with a piece
gives all its occurrences.  They are the edges of a lattice, sorted by position
and relaxed from left to right:

* merging (BPE) models: a segmentation is the tokenizer's own exactly if every
  two neighbours are what it makes of the two joined, so an edge is taken where
  it may follow the piece that the best path so far ends with; the check of a
  pair is remembered;
* unigram models: an edge is taken where it gives the better score.

Characters in no piece become byte pieces, or a run of them the unknown piece.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteprism.llm.common import map_slices, texts
from siteprism.llm.vocabulary import SPACE, Vocabulary

#: Characters indexed at once; units that a worker remembers between slices, and their longest length.
INDEX_CHARS = 1 << 18
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
PAIRS = 1_000_000
#: Bytes of text encoded at once.
SLICE = 1 << 21
_NEVER = float("inf")


def merged(text: str, vocabulary: Vocabulary) -> list[str]:
    """Merge neighbours by best score, leftmost first at ties, until no two make a piece."""
    if len(text) > 40:
        return _merged_long(text, vocabulary)
    rank = vocabulary.rank.get
    parts = list(text)
    ranks = [rank(a + b, _NEVER) for a, b in zip(text, text[1:])]
    while ranks and (best := min(ranks)) < _NEVER:
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
        if i < len(ranks):
            ranks[i] = rank(parts[i] + parts[i + 1], _NEVER)
    return parts


def _merged_long(text: str, vocabulary: Vocabulary) -> list[str]:
    """The same with a queue, for texts of any length."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (both := parts[i] + parts[j]) in vocabulary.rank:
            heapq.heappush(heap, (vocabulary.rank[both], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        j = after[i]
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class SuffixIndex:
    """Occurrences of all pieces in a joined text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.depth = vocabulary.longest
        pieces = list(vocabulary.id_of)
        self.ids = np.array([vocabulary.id_of[p] for p in pieces], np.int64)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        points = sorted({c for p in pieces for c in p})
        self.points = np.array([ord(c) for c in points], np.uint32)  # place + 1 is a character's code; 0 is none
        codes = np.zeros((len(pieces), self.depth), np.uint16)
        for i, p in enumerate(pieces):
            codes[i, : len(p)] = self.codes(np.frombuffer(p.encode("utf-32-le"), np.uint32))
        past = codes.copy()
        past[np.arange(self.depth)[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.low, self.high = self.keys(codes), self.keys(past)

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0).astype(np.uint16)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Rows of codes as byte strings that compare as the rows do."""
        return np.ascontiguousarray(codes.astype(">u2")).view(f"S{2 * self.depth}").ravel()

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all occurrences, by start and end."""
        codes = self.codes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint16)])
        suffixes = self.keys(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[: len(codes)])
        order = np.argsort(suffixes, kind="stable")
        sorted_suffixes = suffixes[order]
        first = np.searchsorted(sorted_suffixes, self.low, "left")
        counts = np.searchsorted(sorted_suffixes, self.high, "right") - first
        which = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
        start, length = order[place], self.lengths[which]
        by = np.lexsort((length, start))
        return start[by], (start + length)[by], self.ids[which[by]]


class Encoder:
    """kind: merge (BPE) or unigram."""

    def __init__(self, vocabulary: Vocabulary, kind: str = "merge") -> None:
        self.vocabulary, self.kind = vocabulary, kind
        self.index = SuffixIndex(vocabulary)
        self.known: dict[str, tuple[int, ...]] = {}
        self.base = len(vocabulary.pieces)  # a character without a piece counts as base + its code point
        self.start = self.base + 0x110000
        self.own = list(range(self.base))  # one int object per id, however often it is remembered
        self.pairs = np.zeros(0, np.int64)
        self.answers = np.zeros(0, bool)
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.id_of.values()) - 10.0

    def _text(self, token: int) -> str:
        return "" if token == self.start else self.vocabulary.pieces[token] if token < self.base else chr(token - self.base)

    def follows(self, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each id may follow: the tokenizer makes just these two of both joined."""
        keys, back = np.unique(last * (self.start + 1) + ids, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        new = keys[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != keys)] if len(self.pairs) else keys
        if len(new):
            asked = []
            for key in new.tolist():
                a, b = (self._text(t) for t in divmod(key, self.start + 1))
                asked.append(merged(a + b, self.vocabulary) == ([a, b] if a else [b]))
            if len(self.pairs) + len(new) > PAIRS:
                self.pairs, self.answers = keys[:0], np.zeros(0, bool)
                return self.follows(last, ids)
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.answers = np.insert(self.pairs, place, new), np.insert(self.answers, place, asked)
        return self.answers[np.searchsorted(self.pairs, keys)][back]

    def learn(self, units: list[str]) -> list[tuple[int, ...]]:
        """Encode units by one index over all of them."""
        text = "\0".join(units) + "\0"
        lengths = np.array([len(u) for u in units], np.int64)
        firsts = np.cumsum(lengths + 1) - lengths - 1
        starts, ends, ids = self.index.edges(text)
        unit = np.searchsorted(firsts, starts, "right") - 1
        inside = ends <= (firsts + lengths)[unit]
        starts, ends, ids, unit = starts[inside], ends[inside], ids[inside], unit[inside]
        if self.kind == "unigram":
            cuts = np.searchsorted(unit, np.arange(len(units) + 1))
            return [tuple(self.best_path(u, list(zip((starts[a:b] - f).tolist(), (ends[a:b] - f).tolist(), ids[a:b].tolist())))) for u, f, a, b in zip(units, firsts.tolist(), cuts, cuts[1:])]
        spaced = np.array([u.startswith(SPACE * 2) for u in units])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        single = np.zeros(len(points), bool)
        single[starts[ends == starts + 1]] = True
        bare = np.flatnonzero(~single)
        owner = np.searchsorted(firsts, bare, "right") - 1
        bare = bare[bare < (firsts + lengths)[owner]]  # not the separators
        starts, ends = np.concatenate([starts, bare]), np.concatenate([ends, bare + 1])
        ids, unit = np.concatenate([ids, points[bare] + self.base]), np.concatenate([unit, np.searchsorted(firsts, bare, "right") - 1])
        rest = ~spaced[unit]
        starts, ends, ids, unit = starts[rest], ends[rest], ids[rest], unit[rest]
        offset = starts - firsts[unit]
        order = np.argsort(offset, kind="stable")
        starts, ends, ids, offset = starts[order], ends[order], ids[order], offset[order]
        last = np.full(len(points) + 1, -1, np.int64)  # the piece that ends there on the path
        begin = np.full(len(points) + 1, -1, np.int64)
        last[firsts] = self.start
        for a, b in itertools.pairwise(np.flatnonzero(np.diff(offset, prepend=-1, append=-1))):
            live = np.flatnonzero(last[starts[a:b]] >= 0) + a
            live = live[self.follows(last[starts[live]], ids[live])]
            last[ends[live]], begin[ends[live]] = ids[live], starts[live]
        # walk all paths back at once; ends of units lie on separators, so no two units share a place
        walked, place, who = [], (firsts + lengths)[~spaced], np.flatnonzero(~spaced)
        while len(place):
            walked.append((who, begin[place], last[place]))
            place = begin[place]
            on = place > firsts[who]
            place, who = place[on], who[on]
        steps = [np.concatenate(x) for x in zip(*walked)] if walked else [np.zeros(0, np.int64)] * 3
        by = np.lexsort((steps[1], steps[0]))
        ends = np.searchsorted(steps[0][by], np.arange(len(units)), "right").tolist()
        bare_at = np.flatnonzero(steps[2][by] >= self.base).tolist()
        path = [self.own[i] if i < self.base else i for i in steps[2][by].tolist()]
        odd = set(np.searchsorted(ends, bare_at, "right").tolist())
        out, a = [], 0
        for k, (u, b) in enumerate(zip(units, ends)):
            if k in odd:
                out.append(tuple(i for t in path[a:b] for i in ([t] if t < self.base else self.vocabulary.fallback(chr(t - self.base)))))
            elif a == b:  # runs of space marks have pieces of one score: pairs don't settle them
                out.append(tuple(i for p in merged(u, self.vocabulary) for i in self._ids(p, [0, len(p)])))
            else:
                out.append(tuple(path[a:b]))
            a = b
        return out

    def _ids(self, unit: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.vocabulary.id_of.get(unit[a:b])
            out += [i] if i is not None else self.vocabulary.fallback(unit[a:b])
        return out

    def best_path(self, unit: str, edges: list[tuple[int, int, int]]) -> list[int]:
        n, scores = len(unit), self.vocabulary.scores
        best: list[float | None] = [None] * (n + 1)
        begin = [0] * (n + 1)
        best[0] = 0.0
        k = 0
        for s in range(n):
            single = False
            while k < len(edges) and edges[k][0] == s:
                end = edges[k][1]
                single = single or end == s + 1
                total = best[s] + scores[edges[k][2]]
                if best[end] is None or total > best[end]:
                    best[end], begin[end] = total, s
                k += 1
            if not single:
                total = best[s] + self.unknown
                if best[s + 1] is None or total > best[s + 1]:
                    best[s + 1], begin[s + 1] = total, s
        cuts = [n]
        while cuts[-1] > 0:
            cuts.append(begin[cuts[-1]])
        return self._ids(unit, cuts[::-1])

    def encode(self, batch: list[str]) -> list[list[int]]:
        split = [self.vocabulary.split(t) for t in batch]
        known = self.known
        new = sorted(set(itertools.chain.from_iterable(split)).difference(known))
        held: list[str] = []
        size = 0
        for u in [*new, None]:
            if held and (u is None or size + len(u) > INDEX_CHARS):
                known.update(zip(held, self.learn(held)))
                held, size = [], 0
            if u is not None:
                held.append(u)
                size += len(u) + 1
        out = [self.vocabulary.joined(list(itertools.chain.from_iterable(map(known.__getitem__, units)))) for units in split]
        for u in new:
            if len(u) > REMEMBERED_CHARS:
                del known[u]
        if len(known) > REMEMBERED:  # those of the last slice stay
            self.known = {u: known[u] for u in set(itertools.chain.from_iterable(split)) if u in known}
        return out


#: The last encoder of this worker process, which serves its next tasks too: what it remembers never changes results.
_LAST: list[Encoder] = []


def encoder_of(vocabulary: Vocabulary, kind: str) -> Encoder:
    if not _LAST or _LAST[0].kind != kind or _LAST[0].vocabulary != vocabulary:
        _LAST[:] = [Encoder(vocabulary, kind)]
    return _LAST[0]


def encode(docs: DataFrame, vocabulary: Vocabulary, kind: str = "merge", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of piece ids), round_trip (whether decoding gives the text again, space marks as spaces); a row per row.

    NULL keeps NULL ids, the empty text has none; both come back.  Texts with characters outside a vocabulary without
    byte pieces don't.  Repeated rows and ids are rows of their own, texts of any length are encoded whole, an empty table
    gives an empty one.  Other columns are left behind.
    """
    rows = texts(docs, doc_id, text)

    def make():
        encoder = encoder_of(vocabulary, kind)

        def work(part: pa.RecordBatch) -> dict:
            batch = part.column("text").to_pylist()
            found = encoder.encode([t or "" for t in batch])
            back = [t is None or vocabulary.decode(x) == t.replace(SPACE, " ") for t, x in zip(batch, found)]
            ids = pa.array([None if t is None else x for t, x in zip(batch, found)], pa.list_(pa.int32()))
            return {"doc_id": part.column("doc_id"), "ids": ids, "round_trip": pa.array(back, pa.bool_())}

        return work

    return map_slices(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, round_trip boolean", most=SLICE)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the ids' text; NULL ids give NULL."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != into)

    def make():
        def work(part: pa.RecordBatch) -> dict:
            found = [None if x is None else vocabulary.decode(x) for x in part.column(ids).to_pylist()]
            return dict(zip(part.schema.names, part.columns)) | {into: pa.array(found, pa.string())}

        return work

    return map_slices(encoded.drop(into), make, f"{kinds}, `{into}` string", None)
