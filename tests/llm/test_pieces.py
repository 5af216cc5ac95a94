import dataclasses
import random

import pytest
import sentencepiece
from conftest import table
from llm_helpers import rows_of

from siteprism.llm import pieces
from siteprism.llm.pieces import Encoder, SuffixIndex, decode, encode, merged
from siteprism.llm.token_counts import Counter, token_counts
from siteprism.llm.vocabulary import parsed, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return read(MODEL)


@pytest.fixture(scope="module")
def batch(spark):
    rng = random.Random(6)
    odd = "aàbc THEIng ▁  \n\t日本½①é😀\x00e²."
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + "the end" + " " * j for k in range(20) for j in (0, 1, 5)]
    texts += ["a" * k for k in range(40)] + ["http://www." * 20, "=" * 300, "1234567890" * 30, "x²." * 9, "don't U.S.A. e.g. (see) [it]: #*$"]
    return texts + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def unigram():
    """The same pieces as a unigram model; the library adds scores in single precision, so runs of spaces get scores of common size."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_merging_as_the_library(vocabulary, batch):
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(batch)
    assert Encoder(vocabulary).encode(batch) == want
    assert all(vocabulary.decode(i) == t.replace("▁", " ") for t, i in zip(batch, want))


def test_unigram_as_the_library(vocabulary, batch):
    want = unigram().encode(batch)
    plain = dataclasses.replace(vocabulary, scores=tuple(max(s, -40_000.0) for s in vocabulary.scores))
    counter = Counter(plain)
    assert [counter.text(t)[0] for t in batch] == [len(x) for x in want]
    assert Encoder(plain, "unigram").encode(batch) == want


def changed(kind: int, keep: int = 6000, **flags) -> bytes:
    """The model with fewer pieces, of another kind and with other flags."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = [p for p in proto.pieces if p.type != 6 or flags.get("bytes")][:keep]
    pieces += [p for p in proto.pieces if p.type == 1 and len(p.piece) == 1 and p.piece in "▁abcdefghijklmnopqrstuvwxyzTHI"]
    one_each = list({p.piece: p for p in pieces}.values())
    del proto.pieces[:]
    proto.pieces.extend(one_each)
    for p in proto.pieces:
        p.score = max(p.score, -40_000)
    proto.trainer_spec.model_type = kind
    proto.trainer_spec.byte_fallback = flags.pop("bytes", False)
    for k, v in flags.items():
        setattr(proto.normalizer_spec, k, v)
    return proto.SerializeToString()


@pytest.mark.parametrize(("kind", "name"), [(1, "unigram"), (2, "merge")])
def test_without_byte_pieces_as_the_library(batch, kind, name):
    """Runs of characters outside the vocabulary are one unknown piece."""
    data = changed(kind)
    want = sentencepiece.SentencePieceProcessor(model_proto=data).encode([*batch, "alpha 日本語 beta", "日本", "日 本", "é日 é"])
    small = parsed(data)
    texts = [*batch, "alpha 日本語 beta", "日本", "日 本", "é日 é"]
    assert any(x.count(small.unknown) > 1 for x in want)
    assert Encoder(small, name).encode(texts) == want
    if name == "unigram":
        counter = Counter(small)
        assert [counter.text(t)[0] for t in texts] == [len(x) for x in want]


def test_models_that_change_texts_are_refused():
    for flags in ({"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"precompiled_charsmap": b"x"}, {"escape_whitespaces": False}):
        with pytest.raises(ValueError, match="asks for"):
            parsed(changed(2, 500, bytes=True, **flags))


def test_memory_of_units_is_bounded_and_shared_by_tasks(vocabulary, batch, monkeypatch):
    want = Encoder(vocabulary).encode(batch)
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    encoder = pieces.encoder_of(vocabulary, "merge")
    got = [x for a in range(0, len(batch), 50) for x in encoder.encode(batch[a : a + 50])]
    assert got == want and len(encoder.known) < 5000
    assert pieces.encoder_of(dataclasses.replace(vocabulary), "merge") is encoder
    assert pieces.encoder_of(vocabulary, "unigram") is not encoder


def test_suffix_index_finds_every_occurrence(vocabulary):
    text = "the theme then\0▁the▁end\0aaaa"
    starts, ends, ids = SuffixIndex(vocabulary).edges(text)
    want = sorted((i, j, vocabulary.id_of[text[i:j]]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in vocabulary.id_of)
    assert list(zip(starts.tolist(), ends.tolist(), ids.tolist())) == want
    assert merged("", vocabulary) == []


def test_decoding(spark, vocabulary):
    assert vocabulary.decode([1, *vocabulary.byte_ids[0xE2:0xE3], 2]) == "�"
    with pytest.raises(ValueError):
        vocabulary.decode([len(vocabulary.pieces)])
    ids = Encoder(vocabulary).encode(["two  words"])[0]
    out = rows_of(decode(spark.createDataFrame([(1, ids, "x"), (2, None, "x"), (3, [], "x")], "k int, ids array<int>, decoded string"), vocabulary))
    assert [r["decoded"] for r in out] == ["two  words", None, ""]


def test_edge_rows(spark, vocabulary, edge, empty, edge_pairs):
    out = rows_of(encode(edge, vocabulary))
    assert len(out) == len(edge_pairs) and all(r["round_trip"] for r in out)
    assert [r["ids"] for r in out if r["doc_id"] == 1] == [None] and [r["ids"] for r in out if r["doc_id"] == 2] == [[]]
    counts = rows_of(token_counts(edge, vocabulary))
    assert len(counts) == len(edge_pairs) and {r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)} == {0}
    assert encode(empty, vocabulary).count() == token_counts(empty, vocabulary).count() == 0
    assert encode(table(spark, [(1, None)]), vocabulary).count() == 1
