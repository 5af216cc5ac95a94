"""Merkle manifest against a plain recursive version."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest
from llm_helpers import rows_of
from oracle import compare, duck
from pyspark.sql import functions as F

from siteprism.llm import merkle, q_merkle
from siteprism.llm.merkle import FIELDS, TOP, checked, forest, group_key, manifest


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict, more: int = 0) -> str:
    values = [row["n_chars"] + more if c == "n_chars" and row[c] is not None else row[c] for c in FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, per leaf its (before, after) from the leaf up)."""
    paths, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, at in enumerate(place):
            run = at // fanout * fanout
            paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        place = [at // fanout for at in place]
        level = [digest(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows: list[dict], fanout: int, tampered) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = (own, *climb([leaf_of(r) for r in own], fanout))
    root, above = climb([trees[g][1] for g in names], fanout)
    out = []
    for g, upper in zip(names, above):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths):
            fold = leaf_of(r, int(tampered(r)))
            for before, after in path + upper:
                fold = digest(before, fold, after)
            out.append((r["doc_id"], leaf_of(r), subroot, root, digest(*[x for s in path + upper for x in s]), fold, fold == root))
    return sorted(out, key=repr)


def hit(r: dict) -> bool:
    return r["doc_id"] is not None and r["n_chars"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0


def found(docs, fanout: int) -> list[tuple]:
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r[c] for c in columns) for r in checked(manifest(docs, now={"n_chars": now}, fanout=fanout)).collect()], key=repr)


@pytest.fixture(scope="module")
def docs(spark, edge):
    langs = F.expr("CASE WHEN doc_id = 6 THEN NULL WHEN doc_id = 8 THEN 'zß' WHEN doc_id = 7 THEN '' ELSE lang END")
    many = spark.range(100, 723).selectExpr("id AS doc_id", "'text ' || id AS text", "CASE WHEN id % 3 = 0 THEN 'é' ELSE 'en' END AS lang", "nullif('s', 's' || id % 2) AS source", "nullif(id, 200) AS n_chars")
    return edge.withColumn("lang", langs).unionByName(many, allowMissingColumns=True)


@pytest.mark.parametrize("fanout", [2, 3])
def test_as_the_plain_version(docs, fanout):
    assert found(docs, fanout) == brute(rows_of(docs), fanout, hit)


def test_tampering_is_seen_only_where_it_happened(docs):
    verified = [(r, v) for r, v in zip(sorted(rows_of(docs), key=lambda r: leaf_of(r)), [x[-1] for x in sorted(found(docs, 2), key=lambda x: x[1])])]
    assert {v for r, v in verified if hit(r)} == {False} and {v for r, v in verified if not hit(r)} == {True}


def test_bands_of_any_height_give_the_same_trees(spark, docs, monkeypatch):
    ids = docs.filter("doc_id >= 100").select(F.lit("t").alias("tree"), F.lit(623).cast("long").alias("n"), (F.col("doc_id") - 100).alias("low"), (F.col("doc_id") - 99).alias("high"), F.sha2("text", 256).alias("digest"))
    leaves = ids.collect()
    root, paths = climb([r["digest"] for r in sorted(leaves, key=lambda r: r["low"])], 2)
    for band in (1, 3, 8):
        monkeypatch.setattr(merkle, "BAND", band)
        trees = forest(ids, 2)
        assert [r["digest"] for r in trees.roots.collect()] == [root]
        got = {r["low"]: [(s["before"].hex(), s["after"].hex()) for s in r["path"]] for r in trees.with_paths(ids).collect()}
        assert got == dict(enumerate(paths))


def test_nodes_cover_nested_intervals(docs):
    nodes = rows_of(manifest(docs).nodes)
    assert {n["tree"] for n in nodes} == {TOP, "-", "=", "=en", "=é", "=zß"}
    for n in nodes:
        assert n["low"] < n["high"] and (n["level"] == 0) == (not n["children"])
        if n["children"]:
            assert [c["high"] for c in n["children"][:-1]] == [c["low"] for c in n["children"][1:]]
            assert (n["children"][0]["low"], n["children"][-1]["high"]) == (n["low"], n["high"])
            assert n["digest"] == digest(*[c["digest"] for c in n["children"]])


def test_groups_sort_null_first_then_by_bytes(spark):
    names = [None, "", "-", "=", "a", "é", "日", "😀"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "g string")
    assert [r["g"] for r in rows.orderBy(group_key(F.col("g"))).collect()] == names


def test_empty_and_single(spark, empty, docs):
    assert found(empty, 2) == [] and manifest(empty).nodes.count() == 0
    one = docs.filter("doc_id = 100")
    assert found(one, 2) == brute(rows_of(one), 2, hit)


def test_checksum_of_the_sql(spark, tmp_path):
    """The SQL twin on more rows than the smallest tables hold, with NULLs."""
    docs = spark.range(3000).selectExpr("CASE WHEN id % 50 = 7 THEN NULL ELSE id * 7919 - 40000 END AS doc_id", "CASE WHEN id % 11 > 0 THEN 'text ' || id END AS text", "CASE id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'é' WHEN 2 THEN '' END AS lang", "nullif('s', 's' || id % 2) AS source", "nullif(id, 200) AS n_chars")
    docs.filter("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    message, n = compare(spark, con, q_merkle.op12_merkle, q_merkle._sql(), str(tmp_path))
    assert not message and n == 2940
