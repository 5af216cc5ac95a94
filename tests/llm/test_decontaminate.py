import hashlib
import random
import re

from conftest import table
from llm_helpers import rows_of

from siteprism.llm.decontaminate import Matcher, counts, hits, masked, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(pairs, items, window):
    known = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            known.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in pairs:
        w = words(t)
        hit, found = set(), set()
        for key, names in known.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i or 0, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows(df):
    return sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(counts(df)))


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = [(str(i), " ".join(rng.choice("ABcdé9") for _ in range(rng.choice([0, 1, 2, 5, 9])))) for i in range(12)] + [("n", None)]
    pairs = [(i, "".join(rng.choice(["a", "b", "c ", " d ", "É", "é ", "9-", "!"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (8 << 20, 20):  # one automaton, and several
        assert rows(hits(table(spark, pairs), bench, window=4, block_bytes=block)) == brute(pairs, items, 4)


def test_edge_rows(spark, edge, empty, edge_pairs):
    bench = spark.createDataFrame([(None, "one"), ("2", "text without an id"), ("2", "word word")], "item_id string, text string")
    out = {r["doc_id"]: r for r in rows_of(hits(edge, bench)) if r["doc_id"] != 5}
    assert out[4]["items"] == [None] and out[None]["items"] in ([], ["2"]) and len(out[7]["hits"]) == 1
    assert counts(hits(edge, bench)).count() == len(edge_pairs) and hits(empty, bench).count() == 0
    nothing = bench.filter("item_id = 'x'")
    assert all(r["n_hit"] == 0 for r in rows_of(counts(hits(edge, nothing))))


def test_places_in_the_original():
    text = "He said: «The QUICK, brown—fox» jumps; then sat.".encode()
    found, items = Matcher([("q", b"quick brown")], 2).find([b"he", b"said", "«the".encode(), b"quick", "brown—fox»".encode()])
    assert found == [] and items == set()
    words_at = [m.group().lower() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    runs, items = Matcher([("q", b"jumps then")], 2).find(words_at)
    assert [text[a:b] for a, b in spans(text, runs)] == [b"jumps; then"] and items == {"q"}
    assert masked(text, runs, b"_").endswith(b" _ sat.")
