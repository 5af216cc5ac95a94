"""Benchmark decontamination with an Aho-Corasick automaton over words.

A text is normalised by lower-casing A-Z and keeping runs of digits, a-z and
everything beyond ASCII as words.  A test item's windows are its runs of
WINDOW words; an item with fewer words is one window.  One automaton over the
windows' words reads every text once; a word inside an occurrence is hit, and
hit runs are mapped back to places in the original text.

A test set of any size works: its items are split into blocks of bounded size,
each with its own automaton, and the rows pass through the blocks in turn
without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import carried, handed_on, map_slices, raw, stored, texts

WINDOW = 13
#: UTF-8 bytes of test items in one automaton.
BLOCK_BYTES = 8 << 20
#: Bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F separate words (after lower-casing).
_SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACED).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Matcher:
    """The automaton of one block of items; items: (item id, text) with bytes or None."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        self.ids: dict[bytes, int] = {}
        for name, text in items:
            for w in windows_of(words_of(text or b""), window):
                owners[tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w)].add(name)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.auto.add_word(key, (len(key), frozenset(names)))
        self.any = bool(owners)
        if self.any:
            self.auto.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit runs [first, after) in words, and the items."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        if self.any and words:
            get = self.ids.get
            for last, (n, names) in self.auto.iter(tuple([get(w, 0) for w in words])):
                runs.append((last - n + 1, last + 1))
                found |= names
        return joined(runs), found


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs with overlapping and touching ones merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "{kept}, {text} n_words long, hits array<struct<first: long, after: long>>, items array<string>"
_RUN = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def _scan(rows: DataFrame, block: list[tuple[str | None, bytes | None]], window: int) -> DataFrame:
    """One pass: adds the block's hits and items to those that the rows carry."""

    def make():
        matcher = Matcher(block, window)

        def work(part: pa.RecordBatch) -> dict:
            n_words, hits, items = [], [], []
            for text, runs, names in zip(raw(part.column("text")), part.column("hits").to_pylist(), part.column("items").to_pylist()):
                words = words_of(text or b"")
                more, found = matcher.find(words)
                n_words.append(len(words))
                hits.append([{"first": a, "after": b} for a, b in joined(more + [(r["first"], r["after"]) for r in runs])])
                items.append(sorted(found.union(names), key=lambda x: (x is not None, x)))
            return handed_on(part) | {"text": part.column("text")} | {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, _RUN), "items": pa.array(items, pa.list_(pa.string()))}

        return work

    return map_slices(rows, make, _HITS.format(kept=carried(rows), text="" if "row" in rows.columns else "text string, "))


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The different items in blocks of about `block_bytes` at most (or one item), each read when it is asked for.

    Dealt by id and text, so an id that comes with many texts fills no block of its own.
    """
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield [(r["item_id"], None if r["text"] is None else r["text"].encode()) for r in part.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per document row: doc_id, text, n_words, hits (runs of hit words), items (ids with an occurring window, sorted).

    A NULL text has no words.  An item without words (or NULL) has no window.  Items with equal ids count as one; a NULL
    id is an item of its own in `items` and in counts of them, and nothing in a digest of their ids.  The driver holds one
    block of items at a time; a benchmark of several blocks takes a pass each, whose hits are stored before the next.  Documents repeated in the input stay repeated.  Other columns of both tables are left behind, or
    the documents' come along in `row` (carry).
    """
    empty = F.array().cast("array<struct<first: long, after: long>>")
    rows = texts(docs, doc_id, text, carry).select("*", empty.alias("hits"), F.array().cast("array<string>").alias("items"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in blocks_of(items, block_bytes):
        rows = rows if found is None else stored(found)
        found = _scan(rows, block, window)
    return found


def counts(found: DataFrame) -> DataFrame:
    """Digest of `hits`: n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words at least is hit)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), *([c for c in found.columns if c in ("row", "text")] if "row" in found.columns else [])).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit runs in words as [start, end) in the bytes of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def masked(text: bytes, runs: list[tuple[int, int]], mask: bytes = b" ") -> bytes:
    """The original text with every hit run replaced by `mask`."""
    out, at = [], 0
    for a, b in spans(text, runs):
        out += [text[at:a], mask]
        at = b
    return b"".join([*out, text[at:]])
