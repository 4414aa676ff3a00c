"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding (operator 11).

A sequence of pieces is the encoding of a text exactly if every piece encodes to
itself and every two adjacent ones stay apart when they are merged anew.  So a
text is read from the left: at each position the longest piece (found for all
positions by one Aho-Corasick pass) that is compatible with the piece before it
is taken; where none is, the position is marked in a bitfield, the last piece is
given back and its next shorter prefix is tried.  The pieces up to a position
are its one encoding, so a marked position fails whatever led to it, and every
position fails at most once.

No piece holds a space mark after another character, so texts fall into words
that are encoded once per worker and put together as ragged arrays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from sentencepiece import SentencePieceProcessor

from foldwise.llm import ragged
from foldwise.llm.common import fields, per_text, pick, require_text, steps

SPACE_MARK = "▁"
_MARK_POINT = ord(SPACE_MARK)
# A text may be cut here: no piece reaches over such a place.
_CUT = re.compile(f"[^{SPACE_MARK}](?={SPACE_MARK})")
_SLICE = 1 << 20
# Words and pairs remembered per worker: memory bounds, not caps on the data.
_WORDS = 500_000
_PAIRS = 1_000_000
# The library's text for an unknown id.
_UNKNOWN_TEXT = " ⁇ "

_PROBES = ("a", " a  b ", "ÅﬁÅ", "\ttab\n", "Ｘ y")


class PieceModel:
    """Pieces, their scores, and what encoding and decoding look up; bounded by the model file."""

    def __init__(self, model: bytes):
        library = SentencePieceProcessor(model_proto=model)
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.size = library.get_piece_size()
        ids = range(self.size)
        self.pieces = [library.id_to_piece(i) for i in ids]
        self.control = np.array([library.is_control(i) for i in ids])
        self.unknown = np.array([library.is_unknown(i) for i in ids])
        self.byte = np.array([library.is_byte(i) for i in ids])
        self.normal = {
            self.pieces[i]: i
            for i in ids
            if not (self.control[i] or self.unknown[i] or self.byte[i] or library.is_unused(i))
        }
        self.score = {p: library.get_score(i) for p, i in self.normal.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if self.byte[i]}
        self._check(library)
        self.longest = ahocorasick.Automaton()
        for piece, i in self.normal.items():
            self.longest.add_word(piece, i)
        self.longest.make_automaton()
        # The longest proper prefix of each piece that is a piece, -1 if there is none.
        self.shorter = [-1] * self.size
        for piece, i in self.normal.items():
            for k in range(len(piece) - 1, 0, -1):
                if piece[:k] in self.normal:
                    self.shorter[i] = self.normal[piece[:k]]
                    break
        self._alone: dict[int, bool] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def _check(self, library: SentencePieceProcessor) -> None:
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces to fall back to")
        inner = [p for p in self.normal if _CUT.search(p)]
        if inner:
            raise ValueError(f"pieces with a space mark inside: {inner[:5]}")
        for text in _PROBES:
            if library.decode(library.encode(text)) != text:
                raise ValueError("only models without text normalisation, with a prefix space, are read")

    def remerge(self, text: str) -> list[str]:
        """Merge characters by the highest score, the leftmost of equal ones, until none applies."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def text(self, token: int) -> str:
        """Of a piece, or of a character without one (a negative number)."""
        return self.pieces[token] if token >= 0 else chr(-token - 1)

    def alone(self, token: int) -> bool:
        """Whether a piece encodes to itself."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = len(self.remerge(self.text(token))) == 1
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two adjacent pieces stay as they are when their characters are merged anew."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            a, b = self.text(left), self.text(right)
            known = self._apart[left, right] = self.remerge(a + b) == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Pieces of a text; characters without a piece as negative numbers."""
        n = len(word)
        longest = array("i", [-1]) * n
        for last, token in self.longest.iter(word):
            longest[last - len(self.pieces[token]) + 1] = token  # later ones are longer
        shorter, pieces = self.shorter, self.pieces
        failed = bytearray((n >> 3) + 1)

        def longest_at(at: int) -> int:
            return longest[at] if longest[at] >= 0 else -ord(word[at]) - 1

        def next_shorter(token: int) -> int | None:
            if token < 0:
                return None
            if shorter[token] >= 0:
                return shorter[token]
            # A piece longer than its first character, which is no piece itself.
            return -ord(pieces[token][0]) - 1 if len(pieces[token]) > 1 else None

        path: list[int] = []
        at, token = 0, longest_at(0) if n else None
        while at < n:
            while token is not None:
                stop = at + (len(pieces[token]) if token >= 0 else 1)
                open_ = not failed[stop >> 3] >> (stop & 7) & 1
                if open_ and self.alone(token) and (not path or self.apart(path[-1], token)):
                    break
                token = next_shorter(token)
            if token is not None:
                path.append(token)
                at = stop
                token = longest_at(at) if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = path.pop()
                at -= len(pieces[token]) if token >= 0 else 1
                token = next_shorter(token)
        return path

    def ids(self, word: str) -> list[int]:
        """Ids of a word's pieces; bytes of characters that have none."""
        found: list[int] = []
        for token in self.encode_word(word):
            if token >= 0:
                found.append(token)
            else:
                found += [self.byte_id[b] for b in chr(-token - 1).encode()]
        return found


class Encoder:
    """Ids of texts; remembers the words it has encoded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = array("I")
        self.offsets = array("q", [0])

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has; without begin and end."""
        sizes = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        marked = [SPACE_MARK + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        for rows, pieces in _slices(marked):
            ids, counts = self._slice(pieces)
            parts.append(ids)
            np.add.at(sizes, rows, counts)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), sizes

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, offsets = ragged.code_points(texts)
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        mark = points == _MARK_POINT
        begins = np.r_[True, mark[1:] & ~mark[:-1]]
        begins[offsets[:-1][offsets[:-1] < len(points)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        codes, hashes, where = ragged.distinct(ragged.span_hashes(points, starts, ends))
        if len(self.known) + len(hashes) > _WORDS:
            self._forget()
        places = np.empty(len(hashes), np.int64)
        for i, (h, at) in enumerate(zip(hashes.tolist(), where.tolist())):
            place = self.known.get(h)
            if place is None:
                place = self.known[h] = len(self.offsets) - 1
                self.flat.extend(self.model.ids(joined[starts[at] : ends[at]]))
                self.offsets.append(len(self.flat))
            places[i] = place
        flat = np.array(self.flat, np.uint32)
        bounds = np.array(self.offsets, np.int64)
        ids, sizes = ragged.gather(flat, bounds, places[codes])
        return ids, ragged.sums_by(sizes, np.searchsorted(starts, offsets))


def _slices(texts: Sequence[str], limit: int = _SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """(row, part) lists of about ``limit`` characters; long texts are cut before a space mark."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > limit:
                found = _CUT.search(text, at + limit - 1)
                stop = found.end() if found else stop
            rows.append(row)
            parts.append(text[at:stop])
            held += stop - at
            at = stop
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


class Decoder:
    """Texts of id sequences, from the table of the pieces' bytes."""

    def __init__(self, model: PieceModel):
        self.model = model
        surfaces = []
        for i, piece in enumerate(model.pieces):
            if model.control[i]:
                surfaces.append(b"")
            elif model.unknown[i]:
                surfaces.append(_UNKNOWN_TEXT.encode())
            elif model.byte[i]:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            else:
                surfaces.append(piece.replace(SPACE_MARK, " ").encode())
        self.surfaces = surfaces
        self.flat = np.frombuffer(b"".join(surfaces), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(s) for s in surfaces])].astype(np.int64)
        self.spaced = np.array([p.startswith(SPACE_MARK) for p in model.pieces])
        self.spaced &= ~(model.control | model.unknown | model.byte)

    def __call__(self, rows: Sequence[bytes | None]) -> list[str | None]:
        ids = np.frombuffer(b"".join(r or b"" for r in rows), "<u4").astype(np.int64)
        if len(ids) and ids.max() >= self.model.size:
            raise ValueError(f"id {int(ids.max())} is not in the model")
        ends = np.cumsum([len(r) // 4 if r else 0 for r in rows], dtype=np.int64)
        data, sizes = ragged.gather(self.flat, self.offsets, ids)
        stops = np.r_[0, np.cumsum(sizes)]
        whole = data.tobytes()
        out: list[str | None] = []
        for row, (a, b) in zip(rows, zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            if row is None:
                out.append(None)
                continue
            text = whole[stops[a] : stops[b]]
            # The space before the first word is not part of the text.
            first = a
            while first < b and self.model.control[ids[first]]:
                first += 1
            skip = first < b and bool(self.spaced[ids[first]])
            last = b
            while last > first and self.model.control[ids[last - 1]]:
                last -= 1
            try:
                # A begin or end id inside the row ends a run of byte pieces.
                if self.model.control[ids[first:last]].any():
                    raise UnicodeError
                out.append(text[skip:].decode())
            except UnicodeError:
                out.append(self._runs(ids[a:b])[skip:])
        return out

    def _runs(self, ids: np.ndarray) -> str:
        """Runs of byte pieces are texts of their own; every wrong byte becomes U+FFFD."""
        parts: list[str] = []
        run = bytearray()
        for i in [*ids.tolist(), None]:
            if i is not None and self.model.byte[i]:
                run += self.surfaces[i]
                continue
            if run:
                parts.append(_lossy(bytes(run)))
                run.clear()
            if i is not None:
                parts.append(self.surfaces[i].decode())
        return "".join(parts)


def _lossy(data: bytes) -> str:
    parts, at = [], 0
    while at < len(data):
        try:
            parts.append(data[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            parts.append(data[at : at + wrong.start].decode() + "�")
            at += wrong.start + 1
    return "".join(parts)


@lru_cache(2)
def _model(data: bytes) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(data)


@lru_cache(2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(_model(data))


@lru_cache(2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(_model(data))


def _broadcast(df: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    df: DataFrame,
    model_file: str,
    key: str = "doc_id",
    text: str = "text",
    begin_end: bool = True,
    decoded: str | None = None,
) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of every row.

    The ids are those of the sentencepiece library without sampling, with its
    begin and end ids if ``begin_end``.  ``model_file`` is a BPE model with byte
    fallback and no normalisation (``ValueError`` otherwise), read on the driver.
    ``decoded`` names a further column with the text that the ids decode to.
    Whole texts are encoded, without a shuffle; NULL counts as empty, which has no
    ids but begin and end.  Repeated and NULL keys are rows of their own, an empty
    table gives an empty one, other columns are ignored; a key column with the name
    of a result raises ``ValueError``.
    """
    require_text(df, text)
    shared = _broadcast(df, model_file)
    result = "n_tokens long, ids binary" + (f", `{decoded}` string" if decoded else "")

    def start():
        encoder = _encoder(shared.value)
        model = encoder.model
        head = np.array([model.begin], "<u4").tobytes() if begin_end else b""
        tail = np.array([model.end], "<u4").tobytes() if begin_end else b""

        def answer(texts):
            flat, sizes = encoder(texts)
            data = flat.astype("<u4").tobytes()
            stops = np.r_[0, np.cumsum(sizes)].tolist()
            rows = [head + data[4 * a : 4 * b] + tail for a, b in zip(stops, stops[1:])]
            columns = {"n_tokens": [len(r) // 4 for r in rows], "ids": rows}
            if decoded:
                columns[decoded] = _decoder(shared.value)(rows)
            return columns

        return answer

    return per_text(df, key, text, result, start)


def decode(df: DataFrame, model_file: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in the binary column ``ids``, as the library decodes it.

    Begin and end ids have no text, unknown ones the library's sign, and bytes that
    are no UTF-8 become U+FFFD; NULL gives NULL, no ids the empty text.  An id
    outside the model raises ``ValueError``; so does an ``output`` that is a column.
    """
    narrow = pick(df, df.columns, fields(f"`{output}` string"))
    shared = _broadcast(df, model_file)
    at = narrow.columns.index(ids)
    schema = StructType([*narrow.schema.fields, StructField(output, fields("t string")[0].dataType)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            for part in steps(batch, at):
                texts = decoder(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=target)

    return narrow.mapInArrow(run, schema)
