"""Exact removal of repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that starts somewhere else
too, in the same text or in another.  Comparing all starting places would mean
a suffix per byte; instead every LENGTH-byte window is represented by one
suffix, the one inside it whose first GRAM bytes hash lowest (leftmost at
ties).  Equal windows choose the same suffix, and some 80 neighbouring windows
share theirs, so a text becomes a short list of *segments*: (suffix, the
windows it stands for).

A suffix array here is the table of such suffixes sorted by a fingerprint of
their first GRAM bytes (core) and of all bytes that their windows cover
(cover): equal beginnings become neighbours, which is all that a scan for
matches needs.  Neighbours with equal cover repeat all their windows; a suffix
whose core has no equal neighbour repeats none; the others are cut finer: into
groups of GROUP windows, then into single windows, and scanned again.

The index family: a batch of texts gets its suffix array, which is merged with
the existing levels of its size and, in the same pass, scanned for matches;
levels of other sizes are merge-scanned with it for matches only.  A level's
size is the number of batches in it, so a suffix is rewritten once per doubling.

Texts stand for 64-bit hashes (with their length), so equal texts share their
result; strings are compared by 64-bit fingerprints of core and cover.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import carried, handed_on, map_slices, raw, shared_dir, small_batches, stored, texts

LENGTH, GRAM, GROUP = 200, 40, 8
#: Bytes of text worked on at once.
SLICE = 1 << 20
#: Bits of a bitmap, and of each of its rows.
BITS, ROW_BITS = 1 << 26, 1 << 15
_U = np.uint64
#: Bits of a hash that hold a place in a part.
_PLACE = 24
_rng = np.random.default_rng(20240)
_CODES = _rng.integers(0, 1 << 64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


class Fingerprints:
    """Fingerprints of substrings of one byte string, from sums over its prefixes."""

    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray) -> None:
        if len(Fingerprints.up) < len(data) + 1:
            n = max(len(data) + 1, 2 * SLICE)
            Fingerprints.up, Fingerprints.down = _powers(_BASE, n), _powers(_INVERSE, n)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_CODES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(end - start, _U) * _U(0xD6E8FEB86659FD93) + np.asarray(salt, _U) * _U(0xA0761D6478BD642F))

    def grams(self, n: int) -> np.ndarray:
        count = max(0, len(self.sums) - n)
        return _mixed((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.down[:count])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` neighbours, by all but the lowest bits; the first one at ties.

    Those bits hold the place while minima are taken, counted from the start of a part that they can number.
    """
    out = np.zeros(max(0, len(grams) - width + 1), np.int64)
    low = _U((1 << _PLACE) - 1)
    step = (1 << _PLACE) - width + 1
    for a in range(0, len(out), step):
        part = grams[a : a + step + width - 1]
        keyed = (part & ~low) | np.arange(len(part), dtype=_U)
        out[a : a + step] = (sliding_least(keyed, width) & low).astype(np.int64) + a
    return out


def pieces_of(text: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of parts of a bounded size that together hold every window of the text once."""
    if len(text) <= 2 * SLICE:
        return [(0, text)]
    return [(a, text[a : a + SLICE + LENGTH - 1]) for a in range(0, len(text) - LENGTH + 1, SLICE)]


def segments(prints: Fingerprints, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of concatenated texts: owner, first and last (window starts), anchor, core, cover.

    ends: where each text ends in `data`.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("owner", "first", "last", "anchor")} | {k: np.zeros(0, _U) for k in ("core", "cover")}
    if len(data) < LENGTH:
        return empty
    grams = prints.grams(GRAM)
    anchor = anchors(grams, LENGTH - GRAM + 1)
    lengths = np.diff(ends, prepend=0)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    valid = np.zeros(len(anchor) + 1, np.int64)
    begins = ends - lengths
    has = windows > 0
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, begins[has] + windows[has], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return empty
    chosen = anchor[at]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    place = chosen[new]
    return {
        "owner": np.searchsorted(ends, first, "right"),
        "first": first,
        "last": last,
        "anchor": place,
        "core": grams[place],
        "cover": prints.of(first, last + LENGTH, (place - first) * 1024 + last - first),
    }


#: A row of a suffix array: text (hash), span (first window start * _SPAN + number of those behind it), core, cover.
#: A row that equals two others of its slice is settled: its span is turned (~) below zero and its core is its own.
_ROW = "text_key long, span long, core long, cover long"
_SPAN = 256
#: What a scan hands on.
_KEPT = ("text_key", "span", "core", "repeats", "open")


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text ('' for NULL), text_key."""
    rows = texts(docs, doc_id, text, carry).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("text_key", F.xxhash64("text", F.octet_length("text")))


def cut(prints: Fingerprints, found: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Windows of segments in groups of `width` offsets to the suffix; a group's core is what all its windows share."""
    counts = found["last"] - found["first"] + 1
    unit = np.repeat(np.arange(len(counts)), counts)
    if not len(unit):
        return found
    start = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts) + found["first"][unit]
    group = (found["anchor"][unit] - start) // width
    heads = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (group[1:] != group[:-1])]))
    who, first, last = unit[heads], start[heads], start[np.concatenate([heads[1:] - 1, [len(unit) - 1]])]
    anchor, offset = found["anchor"][who], group[heads]
    low = anchor - offset * width  # the latest start of the group's windows
    return {
        "owner": found["owner"][who],
        "first": first,
        "last": last,
        "anchor": anchor,
        "core": prints.of(low, low - width + 1 + LENGTH, (offset * 2 + 1).astype(_U) + _mixed(found["core"][who])),
        "cover": prints.of(first, last + LENGTH, (anchor - first) * 1024 + last - first),
    }


def bitmap(keys: DataFrame) -> DataFrame:
    """(bucket, bits) of the keys (column key): BITS bits at most, whatever the number of keys."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    rows = keys.select((F.shiftright(bit, 15)).alias("bucket"), bit.bitwiseAND(F.lit(ROW_BITS - 1)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def broadcast_bitmap(keys: DataFrame):
    """The bitmap as a broadcast string of BITS / 8 bytes."""
    out = bytearray(BITS // 8)
    for r in bitmap(keys).collect():
        out[r["bucket"] * ROW_BITS // 8 : (r["bucket"] + 1) * ROW_BITS // 8] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def beyond_two(core: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Which rows have two equal ones before them: those two show that it repeats, and stand for it elsewhere."""
    order = np.lexsort((cover, core))
    same = np.zeros(len(order), bool)
    same[1:] = (core[order][1:] == core[order][:-1]) & (cover[order][1:] == cover[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[2:]] = same[2:] & same[1:-1]
    return out


def suffix_array(rows: DataFrame, cuts: tuple = ()) -> DataFrame:
    """Suffixes of texts (text, text_key), unsorted.  cuts: (broadcast bitmap of marks, width) for each time they are cut.

    Of equal texts in a slice two take part, which is enough to show that they repeat.
    """

    def make():
        marks = [(np.frombuffer(b.value, np.uint8), width) for b, width in cuts]

        def work(part: pa.RecordBatch) -> dict:
            offsets, blocks, keys, seen = [], [], [], {}
            for key, t in zip(part.column("text_key").to_pylist(), raw(part.column("text"))):
                times = seen[key] = seen.get(key, 0) + 1
                if len(t) >= LENGTH and times <= 2:
                    for offset, block in pieces_of(t):
                        offsets.append(offset)
                        blocks.append(block)
                        keys.append(key)
            ends = np.cumsum([len(b) for b in blocks]).astype(np.int64)
            data = np.frombuffer(b"".join(blocks), np.uint8)
            prints = Fingerprints(data)
            found = segments(prints, data, ends)
            own = np.array(keys, np.int64).view(_U)
            for marked, width in marks:
                bit = ((found["core"] ^ own[found["owner"]]) & _U(BITS - 1)).astype(np.int64)
                there = (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                found = cut(prints, {k: v[there] for k, v in found.items()}, width)
            owner = found["owner"]
            shift = (np.array(offsets, np.int64) - ends + [len(b) for b in blocks])[owner] if blocks else owner
            settled = beyond_two(found["core"], found["cover"])
            span = (found["first"] + shift) * _SPAN + found["last"] - found["first"]
            core = np.where(settled, _mixed(own[owner] + _mixed(span.view(_U))), found["core"])
            columns = {"text_key": own[owner], "span": np.where(settled, ~span, span), "core": core, "cover": found["cover"]}
            return {k: pa.array(v.view(np.int64)) for k, v in columns.items()}

        return work

    return map_slices(rows.select("text_key", "text"), make, _ROW, most=SLICE)


def scan(arrays: DataFrame, only: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Adds to the rows of sorted suffix arrays what their neighbours tell; on request some rows and columns only.

    near: a neighbour has an equal core (with a column `fresh`: and one of both is fresh); repeats: and an equal cover;
    open: the row has to be cut finer, as it doesn't repeat, or as a witness, being the end of a run of equal covers that
    has another cover of its core beside it.  Settled rows repeat and need no neighbour.  One pass over the sorted rows that
    keeps a row at a time, so a core may have any number of rows.
    """
    kinds = dict(arrays.dtypes) | dict.fromkeys(("near", "repeats", "open"), "boolean")
    names = arrays.columns
    wanted = list(columns or kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before: tuple[int, int, bool] | None = None

        def judged(rows: pa.Table, after: bool) -> pa.RecordBatch:
            """All rows, or all but the last if more may follow."""
            nonlocal before
            core, cover = rows.column("core").to_numpy(), rows.column("cover").to_numpy()
            fresh = rows.column("fresh").to_numpy() if "fresh" in names else np.ones(len(core), bool)
            last = before or (core[0] + 1 if core[0] < 0 else core[0] - 1, 0, False)
            same_core = np.concatenate([[last[0] == core[0]], core[1:] == core[:-1], [False]])
            same = np.concatenate([[last[1] == cover[0]], cover[1:] == cover[:-1], [False]]) & same_core
            either = np.concatenate([[last[2] | fresh[0]], fresh[1:] | fresh[:-1], [False]])
            n = len(core) - after
            two = lambda x: (x[:-1] | x[1:])[:n]  # noqa: E731  with the row before or after
            if n:
                before = (core[n - 1], cover[n - 1], fresh[n - 1])
            settled = rows.column("span").to_numpy()[:n] < 0
            alone = settled & fresh[:n]
            near, repeats = two(same_core & either) | alone, two(same & either) | alone
            marks = {"near": near, "repeats": repeats, "open": near & ~settled & (~two(same) | two(~same & same_core))}
            out = {c: rows.column(c).slice(0, n) if c in names else marks[c] for c in wanted}
            out = {c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v) for c, v in out.items()}
            out = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in out.items()}
            return pa.RecordBatch.from_pydict(out).filter(pa.array(marks[only])) if only else pa.RecordBatch.from_pydict(out)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
                yield judged(rows, True)
                held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield judged(held, False)

    return arrays.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def in_order(arrays: DataFrame) -> DataFrame:
    """A very common passage brings two rows a slice and cover to its core's task: settled rows are dealt evenly."""
    return arrays.repartition("core").sortWithinPartitions("core", "cover")


@dataclass
class Level:
    size: int
    rows: DataFrame


class IndexFamily:
    """Levels of suffix arrays in a shared folder; `add` takes a batch and returns what it matches."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.levels: list[Level] = []

    def add(self, rows: DataFrame, last: bool = False) -> list[DataFrame]:
        """Matches of a batch (text, text_key) with itself and all levels, rows of both sides.

        The batch is merged with the levels of its size one after the other, found from the smallest; the pass that
        merges them also scans them, and its result is the new level.  Other levels are scanned with the batch only.
        `last`: no batch follows, so all levels take part in one pass and none is written.
        """
        array, size, merged = suffix_array(rows).withColumn("fresh", F.lit(True)), 1, []
        while self.levels and (self.levels[-1].size == size or last):
            level = self.levels.pop()
            merged.append(level.rows)
            size += level.size
        together = self._with(array, merged)
        if last:
            return [scan(in_order(together), "near", _KEPT)]
        path = f"{self.folder}/level-{size}-{uuid.uuid4().hex}"
        scanned = scan(in_order(together))
        scanned.write.parquet(path)
        scanned = rows.sparkSession.read.schema(scanned.schema).parquet(path)
        found = [scanned.filter("near").select(*_KEPT)] + [scan(in_order(self._with(array, [x.rows])), "near", _KEPT) for x in self.levels]
        self.levels.append(Level(size, scanned.select(*array.columns)))
        return found

    @staticmethod
    def _with(array: DataFrame, others: list[DataFrame]) -> DataFrame:
        for x in others:
            array = array.unionByName(x.withColumn("fresh", F.lit(False)))
        return array


def repeated(rows: DataFrame, batches: int) -> DataFrame:
    """(text_key, span): runs of window starts whose window occurs elsewhere (a run may come more than once); see _ROW."""
    family = IndexFamily(shared_dir(rows.sparkSession))
    found: DataFrame | None = None
    for b in range(batches):
        batch = rows.filter(F.pmod(F.col("text_key"), F.lit(batches)) == b) if batches > 1 else rows
        for part in family.add(batch, b == batches - 1):
            found = part if found is None else found.unionByName(part)
    whole = stored(found)
    mark = F.col("core").bitwiseXOR(F.col("text_key")).alias("key")  # of a suffix in a text
    cuts = ((broadcast_bitmap(whole.filter("open").select(mark)), GROUP),)
    groups = stored(scan(in_order(suffix_array(rows, cuts)), "near", _KEPT))
    cuts += ((broadcast_bitmap(groups.filter("open").select(mark)), 1),)
    single = stored(scan(in_order(suffix_array(rows, cuts)), "repeats", ("text_key", "span")))
    runs = [x.filter("repeats").select("text_key", "span") for x in (whole, groups)]
    found = runs[0].unionByName(runs[1]).unionByName(single)
    return found.withColumn("span", F.when(F.col("span") < 0, F.bitwise_not("span")).otherwise(F.col("span")))


def kept(docs: DataFrame, batches: int = 2, doc_id: str = "doc_id", text: str = "text", carry: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, kept (the bytes that stay, or a text without the parts of characters that a cut leaves), n_bytes, n_removed, n_spans; a row per row.

    Batches are hash parts of the texts.  Texts shorter than LENGTH bytes never change; NULL counts as empty.  Repeated
    rows and equal texts lose everything from LENGTH bytes on (each repeats the other).  Other columns are left
    behind, or come along in `row` (carry).
    """
    rows = keyed_texts(docs, doc_id, text, carry)
    with small_batches(docs.sparkSession):
        spans = stored(repeated(rows, batches).groupBy("text_key").agg(F.collect_set("span").alias("runs")))
    bits = F.broadcast(bitmap(spans.select(F.col("text_key").alias("key"))))  # BITS / ROW_BITS rows at most
    bit = F.col("text_key").bitwiseAND(F.lit(BITS - 1))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit.bitwiseAND(F.lit(ROW_BITS - 1)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.join(bits, F.shiftright(bit, 15) == F.col("bucket"), "left").withColumn("may", F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")), F.lit(0)) == 1).drop("bucket", "bits")
    # only texts that may hold a run are moved to their runs
    still = marked.filter("not may").withColumn("runs", F.lit(None).cast("array<bigint>"))
    joined = marked.filter("may").join(spans, "text_key", "left").select(*still.columns).unionByName(still).drop("may")

    def make():
        def work(part: pa.RecordBatch) -> dict:
            texts, runs = raw(part.column("text")), part.column("runs")
            n = len(texts)
            owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
            span = runs.flatten().to_numpy()
            first = span // _SPAN
            order = np.lexsort((first, owner))
            owner, first, end = owner[order], first[order], (first + span % _SPAN + LENGTH)[order]
            ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
            last = np.maximum.accumulate(end + ends[owner])  # of what lies before, in the joined texts
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (first[1:] + ends[owner[1:]] > last[:-1])
            heads = np.flatnonzero(new)
            owner, first = owner[heads], first[heads]
            end = last[np.append(heads[1:], len(last)) - 1] - ends[owner] if len(heads) else end
            gone = np.bincount(owner, end - first, n).astype(np.int64)
            kept, at = [], 0
            for t, spans in zip(texts, np.bincount(owner, minlength=n).tolist()):
                cuts = [0, *np.stack([first[at : at + spans], end[at : at + spans]], 1).ravel().tolist(), len(t)] if spans else []
                kept.append(b"".join([t[i:j] for i, j in zip(cuts[::2], cuts[1::2])]) if spans else t)
                at += spans
            out = {"kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())}
            counts = {"n_bytes": np.diff(ends), "n_removed": gone, "n_spans": np.bincount(owner, minlength=n)}
            return handed_on(part) | out | {k: pa.array(v, pa.int64()) for k, v in counts.items()}

        return work

    return map_slices(joined.drop("text_key"), make, f"{carried(rows)}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long", most=4 * SLICE)
