import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from foldwise.llm import piece_bpe
from foldwise.llm.piece_bpe import Decoder, Encoder, PieceModel

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return PieceModel(f.read())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def encoded(model, texts):
    flat, sizes = Encoder(model)(texts)
    stops = np.r_[0, np.cumsum(sizes)]
    return [flat[a:b].tolist() for a, b in zip(stops, stops[1:])]


def test_every_code_point_as_the_library(model, library):
    texts = [f"a{c} b{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)])]
    assert encoded(model, texts) == library.encode(texts)


def test_random_pieces_and_runs(model, library):
    rng = random.Random(4)
    pieces = list(model.normal)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    texts += [" " * k for k in range(70)] + ["a" * k for k in range(70)] + ["▁x▁▁", "<s>", "<0x41>", "\x00"]
    assert encoded(model, texts) == library.encode(texts)


def test_long_words_and_cuts(model, library, monkeypatch):
    texts = ["ab" * 30_000, "!" * 30_000, "the quick  brown\n" * 4000, " " * 9000]
    assert encoded(model, texts) == library.encode(texts)
    monkeypatch.setattr(piece_bpe, "_WORDS", 10)
    assert [i for t in piece_bpe._slices([texts[2]], 100) for i in t[1]][0].startswith("the quick")
    assert encoded(model, texts[2:]) == library.encode(texts[2:])


def test_positions_fail_once_and_paths_are_given_back(model):
    # The longest first piece is not always the right one.
    words = ["▁" + w for w in ("thinger", "insteadof", "erest", "nothingness", "ementation")]
    for word in words:
        path = model.encode_word(word)
        assert "".join(map(model.text, path)) == word == "".join(model.remerge(word))
        assert [model.text(t) for t in path] == model.remerge(word)


def test_decoding_any_ids_as_the_library(model, library):
    rng = random.Random(5)
    edge = [0, 1, 2, 28705, 259, *range(3, 259)]
    rows = [[rng.randrange(model.size) for _ in range(rng.randint(0, 6))] for _ in range(5000)]
    rows += [[rng.choice(edge) for _ in range(rng.randint(0, 6))] for _ in range(5000)]
    assert Decoder(model)([packed(r) for r in rows]) == [library.decode(r) for r in rows]


def test_table_as_the_library(documents, odd_rows, library):
    found = piece_bpe.encode(documents(odd_rows, ["'x' AS ids", "1 AS n_tokens"]), MODEL, decoded="back").collect()
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["back"]) for r in found]
    want = []
    for key, text in odd_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), packed(ids), library.decode(ids)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decode_keeps_columns(spark, library):
    ids = library.encode("Ein  Satz.")
    df = spark.createDataFrame([(1, bytearray(packed(ids))), (2, None), (3, bytearray())], "k int, ids binary")
    assert {r["k"]: r["decoded"] for r in piece_bpe.decode(df, MODEL).collect()} == {1: "Ein  Satz.", 2: None, 3: ""}
    with pytest.raises(ValueError):
        piece_bpe.decode(df, MODEL, output="k")


def test_empty_table_clash_and_wrong_type(documents):
    assert piece_bpe.encode(documents([]), MODEL).count() == 0
    with pytest.raises(ValueError):
        piece_bpe.encode(documents([]).withColumnRenamed("doc_id", "ids"), MODEL, key="ids")
    with pytest.raises(TypeError):
        piece_bpe.encode(documents([]), MODEL, text="doc_id")
