import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from foldwise.llm import byte_bpe
from foldwise.llm.token_counts import Counter, MergeTable, count_symbols, newer_classes, token_counts
from foldwise.llm.token_files import TokenFile, TokenWriter, pack, read_tokens, unpack, width, write_tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
FILE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS) as f:
        ranks = byte_bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_as_the_library(documents, odd_rows):
    library = Tokenizer.from_file(WORD_BPE)
    rows = [*odd_rows, (900, "x<|endoftext|>y <|startoftext|>"), (901, "<|ENDOFTEXT|> ΑΣ"), (902, "the " * 3000)]
    got = token_counts(documents(rows, ["1 AS n_tokens", "2 AS over_limit"]), WORD_BPE).collect()
    want = []
    for key, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_counts_of_all_code_points():
    """Letters that are newer than Python's Unicode tables count as the library has them."""
    with open(WORD_BPE, encoding="utf-8") as f:
        vocabulary = f.read()
    library = Tokenizer.from_str(vocabulary)
    count = Counter(vocabulary, newer_classes(library))
    points = map(chr, [*range(1, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200), *range(0xF0000, 0xF0100)])
    texts = [f"a{c} {c}b 1{c}!{c} {c}" for c in points]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert count(texts).tolist() == want


def test_ids_of_all_code_points(documents, encoding):
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]]
    texts = ["\n".join(f"a{c} {c}b 1{c}!{c} {c}" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: bytes(r["ids"]) for r in byte_bpe.encode(documents(rows), RANKS).collect()}
    assert found == {k: np.array(encoding.encode_ordinary(t), "<u4").tobytes() for k, t in rows}
    library = Tokenizer.from_file(FILE_BPE)
    read = {r["doc_id"]: bytes(r["ids"]) for r in read_tokens(write_tokens(documents(rows), FILE_BPE, end_id=2)).collect()}
    want = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in rows}
    assert read == want


def test_counts_of_an_empty_table_and_clashing_key(documents):
    assert token_counts(documents([]), WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        token_counts(documents([]).withColumnRenamed("doc_id", "n_bytes"), WORD_BPE, key="n_bytes")


def test_overlapping_pairs_merge_from_the_left():
    # aa -> X: five letters a make XXa, and a pair that comes first stops the run.
    vocab = {"a": 0, "a</w>": 1, "b</w>": 2, "aa": 3, "aaaa": 4}
    table = MergeTable(
        pairs=np.array([0, 3 * (1 << 20) + 3]), ranks=np.array([0, 1]), made=np.array([3, 4]),
        alone=np.array([False, False]), inner=np.zeros(256, np.int64), final=np.full(256, 2),
    )
    assert count_symbols(table, [b"aaaaab", b"b", b"ab"]).tolist() == [3, 1, 2] and vocab


def test_byte_bpe_as_the_library(documents, odd_rows, encoding):
    rows = [r for r in odd_rows]
    found = byte_bpe.encode(documents(rows, ["'x' AS ids", "1 AS n_tokens"]), RANKS, decoded="bytes").collect()
    want = []
    for key, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((key, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["bytes"])) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_byte_bpe_of_small_chunks(documents, odd_rows, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 50)
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows) if t is None or len(t) < 3000]
    got = {r["doc_id"]: bytes(r["ids"]) for r in byte_bpe.encode(documents(rows), RANKS).collect()}
    assert got == {k: np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes() for k, t in rows}


def test_byte_bpe_of_empty_tables(documents):
    assert byte_bpe.encode(documents([]), RANKS).count() == 0
    assert byte_bpe.encode(documents([(1, None), (2, "")]), RANKS).where("n_tokens = 0").count() == 2


def test_decode_keeps_columns_and_refuses_unknown_ids(spark):
    ids = np.array([50000, 3], "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None), (3, bytearray(b""))], "k int, ids binary")
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(df, RANKS).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and len(got[1]) > 1
    bad = spark.createDataFrame([(bytearray(np.array([60000], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(bad, RANKS).collect()
    with pytest.raises(ValueError):
        byte_bpe.decode(df.withColumnRenamed("k", "decoded"), RANKS)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (unpack(data, bits, 1001) == ids).all()


def test_width_is_the_least():
    assert [width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 5, 1, 130, 64, 0, 63)]
    sink = io.BytesIO()
    writer = TokenWriter(sink, width(5000), block_ids=32)
    for k, ids in enumerate(documents):
        writer.add(np.array([k * 10]), np.array([k != 2]), ids, np.array([len(ids)]))
    assert writer.close() == (7, 263)
    tokens, flat = TokenFile(sink), np.concatenate(documents)
    assert all((tokens.document(k) == ids).all() for k, ids in enumerate(documents))
    for a, b in [(0, 263), (31, 33), (32, 64), (262, 263), (7, 7), (0, 1)]:
        assert (tokens.span(a, b) == flat[a:b]).all()
    assert tokens.keys.tolist() == [0, 10, 20, 30, 40, 50, 60] and not tokens.valid[2]
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(sink.getvalue()[:-1] + b"x"))


def test_files_as_the_library(documents, odd_rows):
    library = Tokenizer.from_file(FILE_BPE)
    rows = [*odd_rows, (903, "a<|endoftext|>b")]
    manifest = write_tokens(documents(rows, ["'f' AS file", "1 AS x"]).drop("file"), FILE_BPE, end_id=2)
    got = sorted(read_tokens(manifest).collect(), key=lambda r: r["start"])
    order = lambda key: (key is not None, key or 0)
    assert [r["doc_id"] for r in got] == sorted([k for k, _ in rows], key=order)
    start, want = 0, {}
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(key, []).append(np.array(ids, "<u4").tobytes())
    for found in got:
        assert (found["start"], found["n_tokens"]) == (start, len(found["ids"]) // 4)
        want[found["doc_id"]].remove(bytes(found["ids"]))
        start += found["n_tokens"]
    assert not any(want.values())


def test_files_of_an_empty_table_and_other_keys(documents, spark):
    manifest = write_tokens(documents([]), FILE_BPE, end_id=2)
    assert manifest.count() == 0 and read_tokens(manifest).count() == 0
    with pytest.raises(TypeError):
        write_tokens(documents([]).selectExpr("string(doc_id) AS doc_id", "text"), FILE_BPE, end_id=2)


def test_queries_agree_with_the_libraries(spark, corpus, encoding):
    from foldwise.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    folder = "/root/testdata/sf0.001"
    for r in QUERIES["op2_byte_bpe"](spark, folder).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    library, start = Tokenizer.from_file(FILE_BPE), 0
    rows = {r["doc_id"]: r for r in QUERIES["op5_token_files"](spark, folder).collect()}
    assert rows.keys() == texts.keys()
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 2]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(rows[key])[1:] == want
        start += len(ids)
