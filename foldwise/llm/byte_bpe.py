"""Byte-level BPE over a global dictionary of distinct words (operator 2).

Texts are exploded into pre-tokens with their positions, a chunk of texts at a
time: a chunk keeps its positions as codes into its own word list.  The word
lists are shuffled by word, so that every distinct word of the corpus is encoded
in one task and once; the ids are joined back to the chunks, where texts are
reassembled by position.  Only word lists and ids cross the network twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldwise.llm import ragged
from foldwise.llm.common import fields, pick, require_text, steps, stored

# Text of a chunk; its word list, codes and ids are what one task step holds.
CHUNK_BYTES = 32 << 20
# Tokens put together at a time when texts are reassembled.
_STEP_TOKENS = 1 << 20
_LEVEL = 6


def read_ranks(text: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and a number a line."""
    lines = (line.split() for line in text.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@lru_cache(2)
def _encoder(text: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(text), special_tokens={}
    )


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all low bytes first, then the next ones."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(_planes(values), _LEVEL)


def _unpack(blob: bytes) -> np.ndarray:
    return _from_planes(zstandard.decompress(blob))


def _pack_ragged(flat: bytes, sizes: np.ndarray) -> bytes:
    """Byte strings: their number, lengths (below 2^16 mostly) and bytes, compressed."""
    head = np.uint32(len(sizes)).tobytes() + _planes(sizes)
    return zstandard.compress(head + flat, _LEVEL)


def _unpack_ragged(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, np.uint8, offset=4 + 4 * n), _from_planes(data[4 : 4 + 4 * n]).astype(np.int64)


class _Chunk:
    """Texts so far: codes of their pre-tokens in order of appearance, and the words."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.words: list[bytes] = []
        self.codes: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, keys: pa.Array, texts: list[str]) -> None:
        sizes = np.zeros(len(texts), np.int64)
        for rows, parts in ragged.slices(texts):
            joined, points, offsets = ragged.code_points(parts)
            starts = ragged.byte_level_spans(points, offsets)
            ends = np.append(starts[1:], len(points))[: len(starts)]
            local, hashes, where = ragged.distinct(ragged.span_hashes(points, starts, ends))
            found = []
            for h, at in zip(hashes.tolist(), where.tolist()):
                code = self.known.get(h)
                if code is None:
                    code = self.known[h] = len(self.words)
                    self.words.append(joined[starts[at] : ends[at]].encode())
                found.append(code)
            self.codes.append(np.array(found, np.uint32)[local])
            np.add.at(sizes, rows, np.diff(np.searchsorted(starts, offsets)))
            self.bytes += len(points)
        self.keys.append(keys)
        self.sizes.append(sizes)

    def row(self, buckets: int) -> dict:
        self.known.clear()
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.uint32)
        self.codes.clear()
        data = np.frombuffer(b"".join(self.words) + bytes(8), np.uint8)
        offsets = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum([len(w) for w in self.words], out=offsets[1:])
        self.words.clear()
        # Frequent words get small codes; equally frequent ones (most occur once)
        # stand in alphabetical order of their beginnings.  Both compress best so.
        counts = np.bincount(codes, minlength=len(offsets) - 1)
        begin = np.zeros(len(counts), np.uint64)
        for i in range(8):
            begin = (begin << np.uint64(8)) | data[offsets[:-1] + i]
        order = np.lexsort((begin, -counts))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        codes = rank[codes]
        data, sizes = ragged.gather(data, offsets, order)
        np.cumsum(sizes, out=offsets[1:])
        bucket = (ragged.span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
        blobs = []
        for k in range(buckets):
            flat, sizes = ragged.gather(data, offsets, np.flatnonzero(bucket == k))
            blobs.append(_pack_ragged(flat.tobytes(), sizes) if len(sizes) else None)
        return {
            "keys": pa.concat_arrays(self.keys), "sizes": np.concatenate(self.sizes),
            "codes": _pack(codes), "buckets": _pack(bucket), "words": blobs,
        }


def _chunks(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """One row per chunk: keys and sizes of its texts, codes by position, words by bucket."""
    kind = df.schema[key].dataType
    rest = fields("sizes array<int>, codes binary, buckets binary, words array<binary>")
    schema = StructType([*fields("chunk long").fields, StructField("keys", fields(f"x array<{kind.simpleString()}>")[0].dataType), *rest.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def closed(chunk: _Chunk) -> pa.RecordBatch:
            nonlocal number
            row = chunk.row(buckets)
            number += 1
            keys = pa.ListArray.from_arrays(pa.array([0, len(row["keys"])], pa.int32()), row.pop("keys"))
            values = [pa.array([number - 1], pa.int64()), keys.cast(target.field("keys").type)]
            values += [pa.array([row[f.name]], target.field(f.name).type) for f in rest.fields]
            return pa.RecordBatch.from_arrays(values, schema=target)

        chunk = _Chunk()
        for batch in batches:
            for part in steps(batch, 1):
                chunk.add(part.column(0), [t or "" for t in part.column(1).to_pylist()])
                if chunk.bytes >= CHUNK_BYTES:
                    yield closed(chunk)
                    chunk = _Chunk()
        if chunk.keys:
            yield closed(chunk)

    return pick(df, [key, text], fields("n_tokens long, ids binary")).mapInArrow(run, schema)


def _word_ids(words: DataFrame, ranks) -> DataFrame:
    """Ids of every word list; each task encodes a word when it first meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        known: dict[bytes, bytes] = {}  # the distinct words of this task's buckets
        for batch in batches:
            blobs = []
            for blob in batch.column("words").to_pylist():
                flat, sizes = _unpack_ragged(blob)
                data, ends = flat.tobytes(), np.cumsum(sizes).tolist()
                out, start = [], 0
                for end in ends:
                    word = data[start:end]
                    ids = known.get(word)
                    if ids is None:
                        found = encoder.encode_ordinary(word.decode())
                        ids = known[word] = np.array(found, "<u4").tobytes()
                    out.append(ids)
                    start = end
                ids = np.frombuffer(b"".join(out), "<u4")
                blobs.append(_pack_ragged(_planes(ids), np.array([len(o) // 4 for o in out])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("bucket"), pa.array(blobs, pa.binary())],
                names=["chunk", "bucket", "ids"],
            )

    return words.mapInArrow(run, "chunk long, bucket int, ids binary")


def _dictionary(parts: list[dict], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's words in order of their codes: flat ids and offsets."""
    flats, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
    for part in sorted(parts, key=lambda p: p["bucket"]):
        flat, size = _unpack_ragged(part["ids"])
        flats.append(_from_planes(flat.tobytes()))
        sizes.append(size)
    flat, size = np.concatenate(flats), np.concatenate(sizes)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    place = np.empty(len(buckets), np.int64)
    place[np.argsort(buckets, kind="stable")] = np.arange(len(buckets))
    flat, size = ragged.gather(flat, offsets, place)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return flat, offsets


def _reassemble(joined: DataFrame, key: StructField, decoded: str | None, ranks) -> DataFrame:
    schema = StructType([key, *fields("n_tokens long, ids binary").fields])
    if decoded:
        schema = schema.add(decoded, "binary")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys = row.column("keys").flatten()
                sizes = row.column("sizes").flatten().to_numpy().astype(np.int64)
                codes = _unpack(row.column("codes")[0].as_py())
                parts = row.column("parts")[0].as_py() or []
                flat, offsets = _dictionary(parts, _unpack(row.column("buckets")[0].as_py()))
                ends = np.cumsum(sizes)
                cuts = [0, *(np.flatnonzero(np.diff(ends // _STEP_TOKENS)) + 1).tolist(), len(sizes)]
                for a, b in zip(cuts, cuts[1:]):
                    start = int(ends[a] - sizes[a])
                    ids, each = ragged.gather(flat, offsets, codes[start : int(ends[b - 1])])
                    bounds = np.zeros(b - a + 1, np.int64)
                    np.cumsum(sizes[a:b], out=bounds[1:])
                    counts = ragged.sums_by(each, bounds)
                    data = memoryview(ids.astype("<u4").tobytes())
                    stops = (4 * np.cumsum(counts)).tolist()
                    blobs = [bytes(data[s:e]) for s, e in zip([0, *stops], stops)]
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(a, b - a).cast(target.field(0).type), pa.array(counts), pa.array(blobs, pa.binary()),
                         *([pa.array(_bytes_of(ids, counts, ranks.value), pa.binary())] if decoded else [])],
                        schema=target,
                    )

    return joined.select("keys", "sizes", "codes", "buckets", "parts").mapInArrow(run, schema)


def encode(
    df: DataFrame, ranks_file: str, key: str = "doc_id", text: str = "text", decoded: str | None = None
) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every row.

    With ``decoded``, a column of that name holds the bytes that the ids decode
    to, made in the same pass; ``decode`` does it for ids from elsewhere.

    Each match of ``public_tokenizers.PATTERN`` in the whole text is merged by
    the ranks of ``ranks_file``, which the driver reads; there are no special
    tokens.  NULL counts as empty (no ids).  Repeated and NULL keys
    are rows of their own, an empty table gives an empty one, other columns are
    ignored.  Chunks are written to the shared folder once, so retries and lost
    executors see the same positions.
    """
    require_text(df, text)
    spark = df.sparkSession
    with open(ranks_file, encoding="ascii") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(32, partitions)
    chunks = stored(_chunks(df, key, text, buckets), "bpe-chunks", compression="none")
    words = (
        chunks.select("chunk", F.posexplode("words").alias("bucket", "words"))
        .where("words IS NOT NULL")
        .repartition(partitions, "bucket")
    )
    parts = _word_ids(words, ranks).groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "ids")).alias("parts")  # a blob a bucket at most
    )
    joined = chunks.drop("words").join(parts, "chunk", "left")
    return _reassemble(joined, df.schema[key], decoded, ranks)


def decode(df: DataFrame, ranks_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each row's ``ids`` in the new column ``decoded``.

    Ids are looked up in the table of token bytes, which has the vocabulary's
    size.  NULL ids stay NULL; an id outside the vocabulary raises ``ValueError``.
    """
    if decoded.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {decoded} already")
    with open(ranks_file, encoding="ascii") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = StructType([*df.schema.fields, *fields(f"`{decoded}` binary").fields])
    target = to_arrow_schema(schema)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at):
                rows = part.column(at).to_pylist()
                which = np.frombuffer(b"".join(r or b"" for r in rows), "<u4")
                blobs = _bytes_of(which, np.array([len(r or b"") // 4 for r in rows]), shared.value)
                blobs = [None if r is None else b for r, b in zip(rows, blobs)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], schema=target)

    return df.mapInArrow(run, schema)


@lru_cache(2)
def _token_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, flat, and their offsets; unused ids are empty."""
    ranks = read_ranks(text)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    offsets = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=offsets[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), offsets


def _bytes_of(ids: np.ndarray, counts: np.ndarray, ranks: str) -> list[bytes]:
    """Bytes of consecutive runs of ``counts`` ids."""
    flat, offsets = _token_bytes(ranks)
    if len(ids) and int(ids.max()) >= len(offsets) - 1:
        raise ValueError(f"token {ids.max()} is not in the vocabulary")
    data, each = ragged.gather(flat, offsets, ids.astype(np.int64))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    stops = np.cumsum(ragged.sums_by(each, bounds)).tolist()
    text = memoryview(data.tobytes())
    return [bytes(text[s:e]) for s, e in zip([0, *stops], stops)]
