"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.catalog.registry import Query, table
from foldwise.llm import byte_bpe, conversations, language, merkle, order_minhash, piece_bpe, quality
from foldwise.llm.decontam import leaks
from foldwise.llm.embeddings import near_duplicates
from foldwise.llm.licenses import scan_licenses
from foldwise.llm.line_dedup import drop_repeated_lines
from foldwise.llm.token_counts import token_counts
from foldwise.llm.token_files import read_tokens, write_tokens

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def held_out(key: str = "doc_id") -> Column:
    """Rows no classifier learns from; a NULL key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, decoded="decoded").select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    manifest = write_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality.BagModel | None:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return quality.learn(documents, labels)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality_model(spark, documents, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.where(~held_out()))
    found = language.detect(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "n_words")


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_counts(documents, public_tokenizers.path("word_bpe_49k.json"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_bpe.encode(table(spark, sf_dir, "documents"), model, decoded="decoded")
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults at places that depend on ``conv_id:turn`` only; NULLs as one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown)) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    left = rows.where(kind != 0)
    return left.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = damaged(original)
    report = conversations.repair(rows, conversations=original)
    found = conversations.with_digest(rows, report)
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), one_more, F.col("text")])
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), checked=F.when(touched, tampered))


def _field(expression: str) -> str:
    text = f"CAST({expression} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# The tree of pairs in two recursions, partitions and then their roots; two more climb them.
_LEVELS_SQL = """
  UNION ALL
  SELECT tree, level + 1, place // 2,
    sha256(concat(max(hash) FILTER (place % 2 = 0), max(hash) FILTER (place % 2 = 1))), (max(n) + 1) // 2
  FROM {0} WHERE n > 1 GROUP BY tree, level, place // 2"""
_CLIMB_SQL = """
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.place // 2, (c.n + 1) // 2, c.proof || coalesce(s.hash, ''),
    sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END)
  FROM {0} c LEFT JOIN {1} s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
  WHERE c.n > 1"""
SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)),
        lambda c, b: list_reduce([xor(c, b)] || range(8),
          lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 7 = 0
      THEN {_leaf_sql("n_chars + 1")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
trees AS (SELECT tree, 0 AS level, place, leaf AS hash, n FROM placed{_LEVELS_SQL.format("trees")}),
subroots AS (
  SELECT tree AS name, hash, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
  FROM trees WHERE n = 1),
top AS (SELECT '' AS tree, 0 AS level, place, hash, n FROM subroots{_LEVELS_SQL.format("top")}),
inside AS (
  SELECT id, tree, 0 AS level, place, n, '' AS proof, coalesce(tampered, leaf) AS folded
  FROM placed{_CLIMB_SQL.format("inside", "trees")}),
above AS (
  SELECT i.id, '' AS tree, 0 AS level, s.place, s.n, i.proof, i.folded
  FROM inside i JOIN subroots s ON s.name = i.tree WHERE i.n = 1{_CLIMB_SQL.format("above", "top")})
SELECT p.doc_id, p.leaf, s.hash AS subroot, t.hash AS root, sha256(a.proof) AS proof_sha256,
  a.folded AS folded_root, a.folded = t.hash AS verified
FROM placed p JOIN subroots s ON s.name = p.tree JOIN above a ON a.id = p.id AND a.n = 1
  JOIN top t ON t.n = 1"""


for _query in (
    op1_order_minhash,
    op2_byte_bpe,
    op3_line_dedup,
    op4_license_scan,
    op5_token_files,
    op6_quality_classifier,
    op7_language_id,
    op8_benchmark_decontamination,
    op9_embedding_near_duplicates,
    op10_token_counts,
    op11_piece_bpe,
    op12_conversation_repair,
    op13_merkle_manifest,
):
    QUERIES[_query.__name__] = _query
