import numpy as np
from conftest import table
from llm_helpers import rows_of
from pyspark.sql import functions as F

from siteprism.llm.language import CLASSES, FILTERS, WIDTHS, Scorer, fit, gradients, has_letter, identify, log_softmax, train, windows_of
from siteprism.llm.q_language import op7_language


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    params = [rng.normal(0, 0.5, (CLASSES, 12)), *[rng.normal(0, 0.3, (w, 12, FILTERS)) for w in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS + 1, 3))]
    x, y = rng.integers(0, CLASSES, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        peaks = []
        for f in params[1:-2]:
            e = params[0][x]
            n = x.shape[1] - len(f) + 1
            peaks.append(sum(e[:, j : j + n] @ f[j] for j in range(len(f))).max(1))
        hidden = np.maximum(np.concatenate(peaks, 1) + params[-2], 0)
        return -log_softmax(np.concatenate([hidden, np.ones((5, 1))], 1) @ params[-1])[np.arange(5), y].mean()

    for p, g in zip(params, gradients(params, x, y)):
        for i in rng.integers(0, p.size, 6):
            old = p.flat[i]
            p.flat[i] = old + 1e-6
            up = loss()
            p.flat[i] = old - 1e-6
            down = loss()
            p.flat[i] = old
            assert abs((up - down) / 2e-6 - g.flat[i]) < 1e-4


def test_tables_are_the_convolution():
    rng = np.random.default_rng(2)
    net = train(rng.integers(1, CLASSES, (64, 256)).astype(np.uint8), rng.integers(0, 2, 64), ["a", "b"], epochs=1)
    x = rng.integers(0, CLASSES, (7, 256)).astype(np.uint8)
    e = net.embedding[x]
    want = np.concatenate([sum(e[:, j : j + 256 - len(f) + 1] @ f[j] for j in range(len(f))).max(1) for f in net.filters], 1)
    hidden = np.maximum(want + net.bias, 0)
    assert np.allclose(Scorer(net).windows(x), log_softmax(np.concatenate([hidden, np.ones((7, 1))], 1) @ net.out), atol=1e-3)


def test_windows_hold_the_whole_text():
    text = ("Abc, d9 é! " * 200).encode()
    w = windows_of(text)
    assert (w != 0).sum() == len("Abc d é " .encode()) * 200 and windows_of(b"").shape == (0, 256)
    assert has_letter("é".encode()) and has_letter(b"1a") and not has_letter("1 — ！\x00".encode()) and not has_letter(b"")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out and lang is not null and length(text) > 100")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95


def test_edge_rows(spark, edge, empty, edge_pairs):
    net = fit(edge.withColumn("lang", F.when(F.col("doc_id") > 4, "xx").otherwise("yy")))
    out = rows_of(identify(edge, net))
    assert len(out) == len(edge_pairs) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = fit(empty)
    assert none.langs == () and {r["lang_pred"] for r in rows_of(identify(edge, none))} == {"und"} and identify(empty, net).count() == 0
