import random
import re

from llm_helpers import rows_of

from siteprism.llm.licence_texts import MORE, TEMPLATES
from siteprism.llm.licences import Scanner, scan

PAIRS = [(n, t) for n, _, t in TEMPLATES]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("licence", "license")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(w):
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


def brute(text, threshold):
    units = [text, *text.split("\n")]
    held = []
    for line in [*text.split("\n"), ""]:
        if words(line):
            held.append(line)
        else:
            units.append("\n".join(held))
            held = []
    out = set()
    for u in units:
        a = grams(words(u))
        for n, t in PAIRS:
            b = grams(words(t))
            if a and 200 * len(a & b) >= threshold * (len(a) + len(b)):
                out.add((2 * len(a & b) / (len(a) + len(b)), n))
    return out


def test_against_brute_force():
    rng = random.Random(1)
    for threshold in (50, 90, 100):
        scanner = Scanner(PAIRS, threshold)
        for _ in range(60):
            parts = []
            for _ in range(rng.randint(1, 4)):
                w = rng.choice(PAIRS)[1].split()
                for _ in range(rng.choice([0, 0, 1, 3, 10])):
                    w[rng.randrange(len(w))] = rng.choice(["noise", "the", "Licence"])
                parts.append(" ".join(w) if rng.random() < 0.6 else "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)))
            text = rng.choice(["\n", "\n\n", " "]).join(parts)
            got = {(2 * c / s, n) for c, s, n in scanner.text(text.encode())}
            assert got == brute(text, threshold)


def test_edge_rows(edge, empty, edge_pairs):
    assert all(r["licences"] == [] and r["licence"] is None and r["score"] is None for r in rows_of(scan(edge, PAIRS)))
    assert scan(edge, PAIRS).count() == len(edge_pairs) and scan(empty, PAIRS).count() == 0
    assert scan(edge, []).count() == len(edge_pairs) and scan(edge, [("none", " ")]).count() == len(edge_pairs)


def test_ties_go_by_name(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT Licence")], "doc_id long, text string")
    found = rows_of(scan(docs, [("b", PAIRS[2][1]), ("a", PAIRS[2][1])]))[0]
    assert (found["licence"], found["score"], found["licences"]) == ("a", 1.0, ["a", "b"])


ALL = [*TEMPLATES, *MORE]
PASSAGES = [(n, t) for n, form, t in ALL if form != "line"]
APACHE_HEADER = """#!/usr/bin/env python
# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""


def sentences(text):
    """A paragraph for each sentence."""
    return "\n\n".join(re.split(r"(?<=[a-z]\.|[A-Z]\.) (?=[A-Z])", text.replace("\n", " ")))


def test_passages_inside_longer_texts(spark):
    code = "\n".join(f"def f{i}(x):\n    return os.path.join(x, str({i}))\n" for i in range(400))
    docs = [(1, APACHE_HEADER + code), (2, "no notice\n\n" + code)]
    for i, (_, t) in enumerate(PASSAGES):
        docs += [(10 + 2 * i, f"{code}\nCopyright 2021 Someone. {sentences(t)}\n{code}"), (11 + 2 * i, f"before it {t} and after it")]
    templates = [(n, t) for n, _, t in ALL]
    found = {r["doc_id"]: r for r in rows_of(scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, passages=PASSAGES))}
    assert found[1]["licence"] == "Apache-2.0" and found[1]["score"] == 1.0 and found[2]["licence"] is None
    for i, (n, _) in enumerate(PASSAGES):
        assert (found[10 + 2 * i]["licence"], found[11 + 2 * i]["licence"], found[11 + 2 * i]["score"]) == (n, n, 1.0)


def test_passages_against_all_runs_of_words():
    rng = random.Random(4)
    short = [("a", "one two three four five six one two seven"), ("b", "two three two four"), ("c", "six six"), ("d", "alone"), ("e", "")]
    for threshold in (50, 75, 90, 100):
        scanner = Scanner([], threshold, short)
        for _ in range(150):
            text = " ".join(rng.choice(["one two three", "four five six", "one two seven", "two", "three", "six", "x", "x y", "\n\n"]) for _ in range(rng.randint(0, 14)))
            w, expected = words(text), {}
            for n, t in short[:3]:
                b = grams(words(t))
                runs = [grams(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
                best = max((2 * len(a & b) / (len(a) + len(b)) for a in runs if 200 * len(a & b) >= threshold * (len(a) + len(b))), default=None)
                if best:
                    expected[n] = best
            assert {n: 2 * c / s for c, s, n in scanner.anywhere(text.encode().split())} == expected
