"""Exact Jaccard join of texts by word n-grams with parity sketches.

A text's set holds the hashes of its distinct word n-grams.  Hashing every
element to a bit and XOR-ing gives a sketch of parities; an element in just one
of two sets flips one bit, so the sketches' Hamming distance is at most the
size of the symmetric difference, which for similar sets is at most
d = (1 - t) / (1 + t) * (sum of sizes).

Pigeonhole join, per band of sizes: the sketch is dealt into k = d + 1 + spare
chunks by the element's hash.  At most d chunks hold a difference, so 1 + spare
chunks at least are equal.  Light chunks (of one element at most, at lower
thresholds empty ones) tell little; they are left out unless a set has more
than `spare` of them (then it is keyed by those too; equal chunks hold equal
elements, so both sides agree on which are light, and pairs of which either set
has few light ones meet under a heavy one).  Bands are as wide as one size
ratio, so a set is keyed in its own band and in the next.

Linked sets share `spare` keys and one, less the light ones ("need").  So a set of
whose keys fewer are anybody else's is linked with nothing and goes.  Of the keys
of the others, linked sets share half the need either under keys of FEW sets at
most, whose pairs are counted, or under the crowded ones, where sets that have so
many are tied to the key's smallest set, not to each other, so a key of any number
of sets gives as many ties.  A passage that many texts hold brings them together
only where it is a large part of them.

The ties' components ("families") contain all linked pairs.  Inside a family, cut
into blocks by size, sets are compared where neither size nor sketch excludes a
link and where no link found before connects them already; links are verified
on the sets themselves.

Equal sets are one node from the start.  Elements and sets stand for 64-bit
hashes of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import checkpointed, give_back, map_slices, raw, release, slices, small_batches, stored, texts
from siteprism.llm.graph import components
from siteprism.llm.suffixes import Fingerprints

#: Spare chunks as a share of d: light chunks are fewer in nearly all sets of a band.
SPARE = 0.35
#: Sets under a key whose pairs are counted.
FEW = 16
#: Elements in a block of a family, where a set counts as LEAST at least.
BLOCK, LEAST = 1 << 22, 256
#: Texts that travel to comparison tasks at a time, as a multiple of all texts.
ROUND = 1.5
SKETCH_BITS = 4096
#: Bytes of text keyed, and hashed, at once.
SLICE, PIECE = 2 << 20, 1 << 19
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def codes_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, place in the text) of its words in lower case, a part of PIECE bytes at a time that ends between words."""
    codes, places, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        data = np.frombuffer(text[at:end].lower(), np.uint8)
        edges = np.flatnonzero(np.diff(_IS_GAP[data], prepend=True, append=True))
        codes.append(Fingerprints(data).of(edges[::2], edges[1::2]))
        places.append(edges[::2] + at)
        at = end
    return np.concatenate(codes), np.concatenate(places)


def sets_of(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct word n-grams.

    With fewer than n words the whole sequence is the one element, without words there is none.
    """
    held = [t or b"" for t in texts]
    codes, places = codes_of(b" ".join(held))
    # a text's words lie before the gap that follows it
    ends = np.searchsorted(places, np.cumsum([len(t) + 1 for t in held]))
    grams = codes[: max(0, len(codes) - n + 1)]
    for i in range(1, n):
        grams = mixed(grams * _U(0x9E3779B97F4A7C15) + codes[i : len(grams) + i])
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= n:
            out.append(np.unique(grams[start : end - n + 1]))
        else:
            short = np.array([end - start] * (end > start), _U)
            for c in codes[start:end]:
                short = mixed(short * _U(0x9E3779B97F4A7C15) + c)
            out.append(short)
        start = end
    return out


def node_of(elements: np.ndarray) -> int:
    """The set's own 64-bit hash, as a signed number."""
    return int.from_bytes(blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def allowed(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The largest symmetric difference of linked sets whose sizes add up to `total`."""
    return (100 - percent) * total // (100 + percent)


@cache
def band_starts(percent: int) -> np.ndarray:
    """First sizes of the bands; linked sets lie in the same band or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return np.array(starts, np.int64)


@cache
def chunks(band: int, percent: int) -> tuple[int, int]:
    """(k, spare) of a band; k is 1 where only equal sets can be linked."""
    most = int(band_starts(percent)[band + 1]) - 1
    d = int(allowed(2 * most, percent))
    if not d:
        return 1, 0
    spare = 2 + int(np.ceil(SPARE * d))
    return d + 1 + spare, spare


def keys_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in `sets`, need) of all sketch chunks by which the sets are to meet.

    need: twice the number of keys that a set shares with each set that it is linked with in the band (at least), and 1 in
    the next band.  Of the equal chunks, `spare` and one, no more are light than either set has; a set with more light ones
    than `spare` is keyed by those as well, but its partner may not be.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.zeros(0, _U)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(band_starts(percent), np.maximum(sizes, 1), "right") - 1
    out_keys, out_places, out_need = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in (0, 1):
        band = own + step
        params = np.array([chunks(int(b), percent) for b in band], np.int64).reshape(-1, 2)
        k, spare = params[:, 0].copy(), params[:, 1]
        k[(sizes == 0) | (k == 1)] = 0
        first = np.cumsum(k) - k
        live = k[owner] > 0
        who = owner[live]
        dealt = mixed(elements[live] ^ mixed(band[who].astype(_U) + _U(77)))
        at = first[who] + (dealt % k[who].astype(_U)).astype(np.int64)
        count = np.bincount(at, minlength=int(k.sum()))
        order = np.argsort(at, kind="stable")
        value = np.zeros(int(k.sum()), _U)
        if len(order):
            full = np.flatnonzero(count)
            # one bit of 2 ** 40 per element and chunk; the parities of a chunk are kept as the XOR of its bits' codes
            bits = mixed((dealt >> _U(24)) ^ _U(0x5EED))[order]
            value[full] = np.bitwise_xor.reduceat(bits, (np.cumsum(count) - count)[full])
        chunk_owner = np.repeat(np.arange(len(sets)), k)
        light = count <= (1 if percent >= 85 else 0)
        n_light = np.bincount(chunk_owner[light], minlength=len(sets))
        many = n_light > spare
        use = ~light | many[chunk_owner]
        need = 2 * np.where(many, 1, spare + 1 - n_light) + step
        number = np.arange(len(value)) - first[chunk_owner]
        tag = mixed(number.astype(_U) * _U(4) + light.astype(_U) + mixed(band[chunk_owner].astype(_U) + _U(0xBA2D)))
        out_keys.append(mixed(value + tag)[use])
        out_places.append(chunk_owner[use])
        out_need.append(need[chunk_owner[use]])
    return np.concatenate(out_keys), np.concatenate(out_places), np.concatenate(out_need)


def text_key() -> Column:
    """A 64-bit hash of the column text."""
    return F.xxhash64("text", F.octet_length("text"))


def nodes(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, node (NULL without shingles), a row per row."""
    rows = texts(docs, doc_id, text).withColumn("text_key", text_key())

    def make():
        def work(part: pa.RecordBatch) -> dict:
            sets = sets_of(raw(part.column("text")), n)
            return {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())}

        return work

    return map_slices(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, text_key long, n_shingles long, node long", most=SLICE)


def keyed(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, need): a row per chunk and set of a slice; see `keys_of`."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            sets = {node_of(s): s for s in sets_of(raw(part.column("text")), n) if len(s)}
            key, place, need = keys_of(list(sets.values()), percent)
            return {"key": pa.array(key.view(np.int64)), "node": pa.array(np.array(list(sets), np.int64)[place]), "need": pa.array(need.astype(np.int32))}

        return work

    return map_slices(texts(docs, doc_id, text).select("text"), make, "key long, node long, need int", most=SLICE)


def by_key(keys: DataFrame) -> DataFrame:
    return keys.repartition("key").sortWithinPartitions("key", "node")


def met(keys: DataFrame) -> DataFrame:
    """The rows whose key another set has too, each once, in one pass over the sorted keys that keeps a row at a time."""
    columns = ("key", "node", "need")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row; whether the one before it has its key

        def shown(rows: list[np.ndarray], which: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(x[which]) for c, x in zip(columns, rows)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            once = np.ones(len(rows[0]), bool)
            once[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [x[once] for x in rows]
            same = np.concatenate([[before], rows[0][1:] == rows[0][:-1]])
            yield shown([x[:-1] for x in rows], same[:-1] | same[1:])
            held, before = [x[-1:] for x in rows], bool(same[-1])
        if before:
            yield shown(held, np.ones(1, bool))

    return by_key(keys).mapInArrow(run, "key long, node long, need int")


def enough(rows: DataFrame, half: bool = False) -> DataFrame:
    """The rows (key, node, need) of sets that have as many of them as they need, or more than half as many."""
    wanted = rows.groupBy("node", "need").agg(F.count("*").alias("n"))
    wanted = wanted.filter(F.col("n") * 2 > F.shiftright("need", 1) if half else F.col("n") >= F.shiftright("need", 1))
    return rows.join(wanted, ["node", "need"], "left_semi")


def counted(rows: DataFrame) -> DataFrame:
    """(key, a, b, need): a row per key and pair of sets a, b, or per set a (b is NULL) where a key has more than FEW.

    Two sets that are both in their next band are left out, as they meet in their own.  One pass over the sorted keys.
    """
    columns = ("key", "node", "need")

    def told(rows: list[np.ndarray], crowded: int | None) -> pa.RecordBatch:
        key = rows[0]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        sizes = np.diff(heads, append=len(key))
        many = np.repeat((sizes > FEW) | (False if crowded is None else key[heads] == crowded), sizes)
        key, node, need = (x[~many] for x in rows)
        left = [np.flatnonzero(key[i:] == key[:-i]) for i in range(1, FEW)]
        x, y = np.concatenate(left), np.concatenate([at + i for i, at in enumerate(left, 1)])
        own = (need[x] & need[y] & 1) == 0
        x, y = x[own], y[own]
        out = {"key": [key[x], rows[0][many]], "a": [node[x], rows[1][many]], "b": [node[y], rows[1][many]], "need": [np.maximum(need[x] >> 1, need[y] >> 1), rows[2][many]]}
        alone = np.arange(len(x) + many.sum()) >= len(x)
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v), mask=alone if c == "b" else None) for c, v in out.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)], None  # rows of the last key, FEW at most; a key of more
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, columns)]
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            full = rows[0][-1] == crowded or len(rows[0]) - start > FEW
            yield told(rows if full else [x[:start] for x in rows], crowded)
            held, crowded = [x[len(x) if full else start :] for x in rows], rows[0][-1] if full else None
        yield told(held, None)

    return by_key(rows).mapInArrow(run, "key long, a long, b long, need int")


def candidates(keys: DataFrame) -> DataFrame:
    """(a, b): ties whose components hold all linked pairs, of the rows of `keyed`."""
    found = stored(counted(enough(stored(met(keys)))))  # the largest shuffle ends in `met`
    pairs = found.dropna(subset=["b"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("2 * n >= need")
    crowded = found.filter("b IS NULL").select("key", F.col("a").alias("node"), "need")
    return pairs.select("a", "b").unionByName(ties(enough(crowded, half=True)))


def ties(keys: DataFrame) -> DataFrame:
    """(a, b): every set that shares a key with the key's smallest set, in one pass over the sorted keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            head = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if not new[0]:
                head[: int(np.argmax(new)) if new.any() else len(head)] = last_head
            last_key, last_head = key[-1], head[-1]
            pairs = np.stack([head, node], 1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return by_key(keys.select("key", "node")).mapInArrow(run, "a long, b long").distinct()


def parities(elements: np.ndarray) -> np.ndarray:
    bits = np.bincount((mixed(elements) & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(_U)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links (places in `sets`) between left and right places that connect all that is linked; places must rise with size."""
    top = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    sketches = np.array([parities(s) for s in sets]).reshape(len(sets), -1)
    out = []
    for i in left.tolist():
        others = right[(right > i) & (100 * sizes[i] >= percent * sizes[right])] if left is right else right[(100 * np.minimum(sizes[i], sizes[right]) >= percent * np.maximum(sizes[i], sizes[right]))]
        if not len(others):
            continue
        others = others[top[others] != top[i]]
        if not len(others):
            continue
        most = allowed(sizes[i] + sizes[others], percent)
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1)
        for j in others[apart <= most].tolist():
            if top[i] != top[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    top[top == top[j]] = top[i]
                    out.append((i, j))
    return out


def verified(docs: DataFrame, node_rows: DataFrame, families: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): links inside the families that connect whatever is linked.

    One text stands for a node, found again by id and hash (a NULL id too).  A family is ordered by size and cut into blocks of BLOCK elements (sums of sizes in two
    levels, so that only blocks' totals of one family are summed in order); blocks meet in pairs where their sizes allow
    a link, each pair in a task of its own; small families share tasks.  A text travels once for each pair its block is
    in; the tasks run in rounds, so that what is on its way at a time is bounded by the texts, however many pairs there are.
    """
    shown = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("shown")
    members = node_rows.dropna(subset=["node"]).groupBy("node").agg(shown, F.first("n_shingles").alias("n")).join(families.select("node", F.col("label").alias("family")), "node")
    level, weight = F.floor(F.log(F.col("n").cast("double")) * 8), F.greatest("n", F.lit(LEAST))
    sums = members.groupBy("family", level.alias("level")).agg(F.sum(weight).alias("sum"), F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    total = sums.groupBy("family").agg(F.sum("sum").alias("total"))
    cells = sums.join(total, "family").withColumn("parts", F.when(F.col("total") <= BLOCK, 1).otherwise(F.ceil(F.col("sum") / BLOCK)).cast("int"))
    cells = cells.withColumn("level", F.when(F.col("total") <= BLOCK, F.lit(-1).cast("bigint")).otherwise(F.col("level")))
    cells = cells.groupBy("family", "level").agg(F.max("parts").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("total").alias("total"))
    blocks = cells.select("family", "level", "low", "high", "total", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x, y = blocks.alias("x"), blocks.filter("level >= 0").alias("y")
    meet = x.filter("level >= 0").join(y, (F.col("x.family") == F.col("y.family")) & (F.struct("x.level", "x.part") <= F.struct("y.level", "y.part")) & (100 * F.col("x.high") >= percent * F.col("y.low")))
    pairs = meet.select(F.col("x.family").alias("family"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("level", "part")])
    task = F.xxhash64("family", "level_x", "part_x", "level_y", "part_y")
    same = (F.col("level_x") == F.col("level_y")) & (F.col("part_x") == F.col("part_y"))
    wanted = pairs.select("family", F.col("level_x").alias("level"), F.col("part_x").alias("part"), task.alias("task"), F.when(same, 0).otherwise(1).alias("side")).unionByName(
        pairs.filter(~same).select("family", F.col("level_y").alias("level"), F.col("part_y").alias("part"), task.alias("task"), F.lit(2).alias("side"))
    )
    placed = members.join(total, "family").withColumn("small", F.col("total") <= BLOCK)
    large = placed.filter("not small").withColumn("level", level).join(cells.select("family", "level", "parts"), ["family", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    large = large.join(wanted, ["family", "level", "part"]).select("shown", "node", "n", "family", "task", "side")
    whole = members.agg(F.sum(weight).alias("all")).first()["all"] or 0
    shared = F.pmod(F.xxhash64("family"), F.lit(max(1, 4 * whole // BLOCK)))
    small = placed.filter("small").select("shown", "node", "n", "family", shared.alias("task"), F.lit(0).alias("side"))
    rows = checkpointed(small.unionByName(large)).withColumns({"id": F.col("shown.doc_id"), "key": F.col("shown.text_key")}).drop("shown")
    moved, held = rows.agg(F.sum("n")).first()[0] or 0, node_rows.agg(F.sum("n_shingles")).first()[0] or 0
    rounds = max(1, int(np.ceil(moved / max(1, ROUND * held))))
    own = texts(docs, doc_id, text).withColumn("text_key", text_key())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple]] = {}
        seen = set()
        for part in (p for batch in batches for p in slices(batch, most=SLICE)):  # sets are held, texts are not
            for s, family, node, side in zip(sets_of(raw(part.column("text")), n), *(part.column(c).to_pylist() for c in ("family", "node", "side"))):
                if (node, side) not in seen:  # repeated rows
                    seen.add((node, side))
                    if len(s) and node_of(s) == node:
                        mine.setdefault(family, []).append((len(s), node, side, s))
        part = None
        a, b = [], []
        for members in mine.values():
            members.sort(key=lambda r: r[:2])
            sets, side = [r[3] for r in members], np.array([r[2] for r in members])
            everyone = np.arange(len(members))
            found = links(sets, everyone, everyone, percent) if not side.any() else links(sets, everyone[side == 1], everyone[side == 2], percent)
            a += [members[x][1] for x, _ in found]
            b += [members[y][1] for _, y in found]
            members.clear()
        mine, sets, s = {}, [], None
        give_back()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def links_of(rows: DataFrame) -> DataFrame:
        # texts travel, as they are smaller than their sets
        found = own.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
        return found.select("text", "task", "family", "node", "side").groupBy("task").applyInArrow(compare, "a long, b long")

    parts = [stored(links_of(rows.filter(F.pmod(F.xxhash64("task"), F.lit(rounds)) == i))) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def classes(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, label (of the component; NULL without shingles), component_id; see `join`."""
    with small_batches(docs.sparkSession):
        node_rows = checkpointed(nodes(docs, n, doc_id, text))
        families = checkpointed(components(stored(candidates(keyed(docs, n, percent, doc_id, text)))))
        release(docs.sparkSession)
        labels = checkpointed(components(verified(docs, node_rows, families, n, percent, doc_id, text)))
        release(docs.sparkSession)
    marked = node_rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = marked.dropna(subset=["label"]).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.join(least, "label", "left").select("doc_id", "text_key", "n_shingles", "label", own.alias("component_id"))


def join(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included); a row per row.

    Texts are linked at a Jaccard coefficient of `percent` / 100 or more.  NULL and texts without words have no shingle
    and are linked with nothing; equal texts are linked.  Rows with a NULL doc_id take part (component_id is NULL where
    no row of the component has an id); rows that repeat an id are rows of their own.  Other columns are left behind.
    """
    return classes(docs, n, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")
