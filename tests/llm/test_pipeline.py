import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from __spark_entry__ import oracle_sql, queries
from foldwise.llm import byte_bpe, order_minhash
from foldwise.llm.common import steps
from foldwise.llm.decontam import leaks
from tests.llm.test_dedup import brute_groups, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one_as_brute_force(spark, corpus):
    (_, good), (_, lines), (_, distinct), (_, clean), (_, ids) = corpus_pipeline.STAGES
    columns = corpus.columns

    first = good(spark, corpus, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in first.collect()}
    assert first.columns == columns
    judged = [(k in stay) == bool(q) for k, q in labels.items()]
    assert np.mean(judged) > 0.9

    second = lines(spark, first, SF)
    want = {k: t for k, (t, _, n) in brute_lines([(r["doc_id"], r["text"]) for r in first.collect()]).items() if not n or t.strip()}
    rows = second.collect()
    assert second.columns == columns and {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    third = distinct(spark, second, SF)
    roots = brute_groups(want)
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == set(roots.values())

    fourth = clean(spark, third, SF)
    found = {r["doc_id"] for r in leaks(third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert fourth.columns == columns and kept.keys() == {r["doc_id"] for r in third.collect()} - found

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        ranks = byte_bpe.read_ranks(f.read())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in ids(spark, fourth, SF).collect():
        assert r["text"] == kept[r["doc_id"]]
        assert bytes(r["ids"]) == np.array(encoding.encode_ordinary(r["text"]), "<u4").tobytes()


def test_run_and_registration(spark):
    assert queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries() if q.startswith("op")}
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids", "text"] and found.count() > 100


def test_stages_on_odd_and_empty_tables(spark, documents, odd_rows):
    extra = ["'en' AS lang", "'s' AS source", "bigint(length(text)) AS n_chars", "'x' AS kept", "1 AS n_tokens"]
    docs = documents(odd_rows, extra)
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:4]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns, name
        corpus_pipeline.STAGES[4][1](spark, rows, SF).collect()


def test_sketching_takes_little_memory():
    """A worker's arrays while texts are sketched: 4 MB of words at a time took over 200 MB."""
    import tracemalloc

    words = [f"w{i * 7919 % 5003}" for i in range(800_000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    for part in steps(batch, 0, order_minhash.STEP):
        order_minhash.buckets_of(*order_minhash.word_tokens(part.column(0).to_pylist()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
