"""Language identification by naive Bayes over hashed character n-grams (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foldwise.llm import ragged
from foldwise.llm.common import per_text, require_text, stored

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
# The matrix of log-probabilities holds BUCKETS floats a language: 64 MB at most.
MOST_LANGUAGES = 256
UNKNOWN = "und"

_SPACE = 32
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower case of every letter, a space for any other code point."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in np.flatnonzero(ragged.char_classes() == ragged.LETTER).tolist():
        lower = chr(c).lower()
        table[c] = ord(lower) if len(lower) == 1 else c
    return table


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with the part each is in, and letters per part.

    Anything but letters counts as one space, and a part begins and ends with one.
    """
    _, points, offsets = ragged.code_points([f" {p} " for p in parts])
    chars = _letters()[points]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(offsets))
    blank = chars == _SPACE
    letters = np.bincount(owner[~blank], minlength=len(parts))
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    buckets, owners = [], []
    for size in LENGTHS:
        n = len(chars) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(31) + chars[i : i + n] * _FACTORS[i]
        whole = owner[:n] == owner[size - 1 :]
        if size == 1:
            whole = whole & (chars != _SPACE)
        buckets.append((ragged.mix(h)[whole] >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:n][whole])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int32), letters
    return np.concatenate(buckets), np.concatenate(owners), letters


@dataclass
class LanguageModel:
    """Sorted language names, log priors and a languages x buckets matrix."""

    names: list[str]
    priors: np.ndarray
    matrix: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log joint of each text with each language, and its letters."""
        total = np.tile(self.priors, (len(texts), 1))
        letters = np.zeros(len(texts), np.int64)
        for rows, parts in ragged.slices([t or "" for t in texts]):
            buckets, owner, found = ngrams(parts)
            np.add.at(letters, rows, found)
            for k, row in enumerate(self.matrix):
                sums = np.bincount(owner, row[buckets], minlength=len(parts))
                np.add.at(total[:, k], rows, sums)
        return total, letters


def ngram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``bucket``, ``n`` (and ``docs`` at bucket -1) over all rows with both values."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for frame in batches:
            for name, rows in frame.groupby("lang"):
                table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
                docs[name] = docs.get(name, 0) + len(rows)
                for _, parts in ragged.slices(rows["text"].tolist()):
                    table += np.bincount(ngrams(parts)[0], minlength=BUCKETS)
        for name, table in tables.items():
            used = np.flatnonzero(table)
            yield pd.DataFrame(
                {"lang": name, "bucket": np.r_[-1, used], "n": np.r_[docs[name], table[used]]}
            )

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    partial = rows.mapInPandas(count, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row of ``df`` with a text and a language.

    Counts are summed by Spark; the driver gets at most ``BUCKETS`` numbers for
    each language.  More than ``MOST_LANGUAGES`` distinct languages raise
    ``ValueError``; none at all gives a model that answers ``und``.
    """
    require_text(df, text)
    counts = stored(ngram_counts(df, text, lang), "ngram-counts")
    docs = counts.where("bucket = -1").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(docs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; map the column to fewer first")
    names = [r["lang"] for r in docs]
    matrix = np.full((len(names), BUCKETS), smoothing)
    frame = counts.where("bucket >= 0").toPandas()
    matrix[np.searchsorted(names, frame["lang"]), frame["bucket"]] += frame["n"]
    matrix = np.log(matrix / matrix.sum(1, keepdims=True))
    share = np.array([r["n"] for r in docs], float)
    return LanguageModel(names, np.log(share / share.sum()), matrix.astype(np.float32))


def detect(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (posterior probability) of every row.

    Texts that are NULL or hold no letter, and all texts when nothing was
    learned, are ``und`` with score 0.  Ties go to the first name in sorted
    order.  Repeated and NULL keys are rows of their own; an empty table gives
    an empty one; other columns are ignored.
    """
    require_text(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def answer(texts):
            if not known.names:
                return {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
            total, letters = known.scores(texts)
            best = total.argmax(1)
            odds = np.exp(total - total.max(1, keepdims=True))
            score = np.where(letters > 0, odds.max(1) / odds.sum(1), 0.0)
            names = [known.names[b] if n else UNKNOWN for b, n in zip(best, letters)]
            return {"lang_pred": names, "score": score}

        return answer

    return per_text(df, key, text, "lang_pred string, score double", start)
