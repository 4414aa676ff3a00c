"""Token ids in fixed-width bit-packed files (operator 5).

A file holds one range of documents in ascending key order:

    magic | blocks | block offsets | document starts | keys | key validity | trailer

Ids take the fewest bits that hold the vocabulary, least significant bit first,
``BLOCK_IDS`` to a block (fewer in the last); a block begins at a byte, so any
span of ids is read by fetching and unpacking the blocks it touches.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from foldwise.llm import ragged
from foldwise.llm.common import fields, pick, require_text, steps, stored
from foldwise.session import scratch_path

MAGIC = b"TOKPACK1"
BLOCK_IDS = 1 << 16
# bits, ids a block, documents, ids, place of the block offsets
_TRAILER = struct.Struct("<IIQQQ8s")
# Ids handed on at a time when a file is read in order.
_STEP_IDS = 1 << 20
# Words remembered per worker; a memory bound, not a cap on words.
_REMEMBERED = 1_000_000


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, ``bits`` each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    each = np.zeros((count, 32), np.uint8)
    each[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel()


class TokenWriter:
    """Writes one file; holds a block of ids and the index of its documents."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.waiting = np.empty(0, np.uint32)
        self.keys: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.offsets = [len(MAGIC)]
        self.ids = 0
        sink.write(MAGIC)

    def add(self, keys: np.ndarray, valid: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with their ids, one after the other."""
        self.keys.append(keys.astype("<i8"))
        self.valid.append(valid.astype(np.uint8))
        self.sizes.append(sizes.astype("<i8"))
        self.ids += len(ids)
        held = np.concatenate([self.waiting, ids.astype(np.uint32)])
        whole = len(held) // self.block_ids * self.block_ids
        for k in range(0, whole, self.block_ids):
            self._block(held[k : k + self.block_ids])
        self.waiting = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if len(self.waiting):
            self._block(self.waiting)
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, "<i8")
        starts = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=starts[1:])
        for part in (np.array(self.offsets, "<i8"), starts, *self.keys, *self.valid):
            self.sink.write(part.tobytes())
        self.sink.write(_TRAILER.pack(self.bits, self.block_ids, len(sizes), self.ids, self.offsets[-1], MAGIC))
        return len(sizes), self.ids


class TokenFile:
    """Random access to one file through any seekable binary source."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - _TRAILER.size)
        self.bits, self.block_ids, self.documents, self.ids, at, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or one that was cut short")
        blocks = -(-self.ids // self.block_ids)
        source.seek(at)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<i8")
        self.starts = np.frombuffer(source.read(8 * (self.documents + 1)), "<i8")
        self.keys = np.frombuffer(source.read(8 * self.documents), "<i8")
        self.valid = np.frombuffer(source.read(self.documents), np.uint8).astype(bool)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; reads only the blocks that hold them."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for k in range(first, last + 1):
            count = min(self.block_ids, self.ids - k * self.block_ids)
            a, b = self.offsets[k : k + 2] - self.offsets[first]
            parts.append(unpack(data[a:b], self.bits, count))
        base = first * self.block_ids
        return np.concatenate(parts)[start - base : stop - base]

    def document(self, number: int) -> np.ndarray:
        return self.span(int(self.starts[number]), int(self.starts[number + 1]))


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct word once."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 14, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        apart = [i for i, t in enumerate(texts) if self.special and self.special.search(t)]
        plain = texts
        if apart:
            plain = list(texts)
            for i in apart:
                plain[i] = ""
        sizes = np.zeros(len(texts), np.int64)
        found = [np.empty(0, np.uint32)]
        for rows, parts in ragged.slices(plain):
            ids, each = self._slice(parts)
            found.append(ids)
            np.add.at(sizes, rows, each)
        ids = np.concatenate(found)
        if not apart:
            return ids, sizes
        pieces = np.split(ids, np.cumsum(sizes)[:-1])
        for i in apart:
            # The library itself finds special tokens inside a text.
            pieces[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)

    def _slice(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, bounds = ragged.code_points(parts)
        starts = ragged.byte_level_spans(points, bounds)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        codes, hashes, where = ragged.distinct(ragged.span_hashes(points, starts, ends))
        keys = hashes.tolist()
        if len(self.known) + len(keys) > _REMEMBERED:
            self._forget()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            at = where[new]
            words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn([keys[i] for i in new], words)
        which = np.array([self.known[k] for k in keys], np.int64)
        ids, each = ragged.gather(self.flat, self.offsets, which[codes] if len(which) else which)
        return ids, ragged.sums_by(each, np.searchsorted(starts, bounds))

    def _learn(self, keys: list[int], words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array([i for word in found for i in word], np.uint32)
        n, used = len(self.known), int(self.offsets[len(self.known)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(keys) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[used : used + len(ids)] = ids
        self.offsets[n + 1 : n + 1 + len(keys)] = used + np.cumsum([len(w) for w in found])
        self.known.update(zip(keys, range(n, n + len(keys))))


@lru_cache(2)
def _encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


def write_tokens(
    df: DataFrame, vocabulary_file: str, end_id: int, key: str = "doc_id",
    text: str = "text", path: str | None = None,
) -> DataFrame:
    """Encode whole texts and write them in ascending key order; returns the manifest.

    One row per file: ``shard``, ``file``, ``n_docs``, ``n_tokens`` and ``start``
    (ids in all files before it).  ``end_id`` closes every document; a NULL text
    counts as empty.  Equal keys are ordered by hashes of their texts and NULL keys come first.
    Keys must be whole numbers.  ``path`` is a folder that all executors reach
    (default: a new one in the shared folder).  A file is named by the attempt
    that wrote it and counts once the manifest lists it, so repeated and lost
    attempts leave nothing half-written behind.  An empty table gives no files;
    other columns are ignored.
    """
    require_text(df, text)
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"key column {key} is {kind}, not a whole number")
    spark = df.sparkSession
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast(content)
    entries = json.loads(content)
    vocabulary = max([end_id, *entries["model"]["vocab"].values(), *(t["id"] for t in entries["added_tokens"])]) + 1
    bits = width(vocabulary)
    folder = path or scratch_path(spark, "tokens")
    narrow = pick(df, [key, text], fields("shard int, file string, n_docs long, n_tokens long"))
    # By hashes, not by texts: samples for the ranges go to the driver.
    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(f"`{text}`"), F.xxhash64(F.lit(1), f"`{text}`")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = _encoder(shared.value)
        writer = sink = None
        for batch in batches:
            for part in steps(batch, 1):
                if writer is None:
                    system, place = fs.FileSystem.from_uri(folder)
                    system.create_dir(place, recursive=True)
                    name = f"part-{shard:06d}-{uuid.uuid4().hex}.tokens"
                    sink = system.open_output_stream(f"{place}/{name}")
                    writer = TokenWriter(sink, bits)
                ids, sizes = encode([t or "" for t in part.column(1).to_pylist()])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                keys = part.column(0)
                valid = keys.is_valid().to_numpy(zero_copy_only=False)
                writer.add(keys.fill_null(0).to_numpy(), valid, ids, sizes + 1)
        if writer is not None:
            documents, tokens = writer.close()
            sink.close()
            values = [[shard], [f"{folder}/{name}"], [documents], [tokens]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "file", "n_docs", "n_tokens"]
            )

    files = stored(ordered.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long"), "token-manifest")
    # One row per file: the window holds as many rows as there are partitions.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the files: ``key``, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit.  A task takes whole files and unpacks them step by step.
    """
    target = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["file"])
                with system.open_input_file(place) as source:
                    tokens = TokenFile(source)
                    marks = tokens.starts[1:] // _STEP_IDS
                    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), tokens.documents]
                    for a, b in zip(cuts, cuts[1:]):
                        starts = tokens.starts[a : b + 1]
                        data = memoryview(tokens.span(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                        at = ((starts - starts[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(tokens.keys[a:b], mask=~tokens.valid[a:b]),
                            pa.array(starts[:-1] + row["start"]),
                            pa.array(np.diff(starts)),
                            pa.array([bytes(data[s:e]) for s, e in zip(at, at[1:])], pa.binary()),
                        ], schema=target)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("shard", "file", "start").repartition(partitions, "shard")
    return spread.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")
