"""Document quality by attention-based multiple-instance learning (operator 6).

A document is a bag of passages and only the bag is labelled.  Every passage is
encoded, gated attention weighs the encodings, and the weighted sum is scored:
    h = tanh(x W + b),  a = softmax(w . (tanh(h V) * sigmoid(h U))),  p = sigmoid(c . sum(a h)).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foldwise.llm import ragged
from foldwise.llm.common import filter_texts, per_text, require_text

PASSAGE_BYTES = 512
# Labelled rows a model is fitted on at most; the rest of a large label set is not read.
SAMPLE_ROWS = 6000

_KINDS = 16
FEATURES = _KINDS * _KINDS


def _byte_kinds() -> np.ndarray:
    """Sixteen kinds of bytes: what a byte looks like, not which letter it is."""
    kinds = np.full(256, 15, np.int64)
    groups = ["\n\r", " \t", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "0123456789", ".", ",", "!?", ":;", "'\"`", "()[]{}<>", "*#", "$%&@", "|\\/", "-_+=~^"]
    for i, group in enumerate(groups):
        kinds[[ord(c) for c in group]] = i
    kinds[128:] = 2  # parts of letters outside ASCII, mostly
    return kinds


_BYTE_KINDS = _byte_kinds()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the text each belongs to.

    A passage is a window of ``PASSAGE_BYTES`` bytes; its features are the
    square roots of the shares of its pairs of adjacent byte kinds.  An empty
    text has one passage without any pair.
    """
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    found, owners = [], []
    for a, b in ragged.byte_slices(data):
        sizes = np.array([len(d) for d in data[a:b]], np.int64)
        number = np.maximum(1, -(-sizes // PASSAGE_BYTES))
        owner = np.repeat(np.arange(a, b), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        length = np.minimum(PASSAGE_BYTES, sizes[owner - a] - nth * PASSAGE_BYTES)
        kinds = _BYTE_KINDS[np.frombuffer(b"".join(data[a:b]), np.uint8)]
        at = np.repeat(np.arange(len(owner)), length)
        inside = at[1:] == at[:-1]
        code = (at[:-1] * FEATURES + kinds[:-1] * _KINDS + kinds[1:])[inside]
        counts = np.bincount(code, minlength=len(owner) * FEATURES).reshape(-1, FEATURES)
        found.append(np.sqrt(counts / np.maximum(1, length - 1)[:, None]).astype(np.float32))
        owners.append(owner)
    if not found:
        return np.empty((0, FEATURES), np.float32), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class BagModel:
    """Weights of encoder (W, b), gated attention (V, U, w) and score (c, c0)."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int, hidden: int = 32, gate: int = 16) -> BagModel:
        rng = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        return BagModel(weights | {"b": np.zeros(hidden), "c0": np.zeros(1)})

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """``begins``: where each bag starts; bags are not empty."""
        p = self.weights
        sizes = np.diff(np.r_[begins, len(x)])
        bag = np.repeat(np.arange(len(begins)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        left, right = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (left * right) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, begins)[bag])
        a /= np.add.reduceat(a, begins)[bag]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        out = _sigmoid(z @ p["c"] + p["c0"])
        return {"bag": bag, "h": h, "left": left, "right": right, "a": a, "z": z, "p": out}

    def gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.weights, self.forward(x, begins)
        bag, h, a, left, right = s["bag"], s["h"], s["a"], s["left"], s["right"]
        dl = (s["p"] - y) / len(y)
        dz = dl[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, begins)[bag])
        dg = de[:, None] * p["w"]
        dleft, dright = dg * right * (1 - left**2), dg * left * right * (1 - right)
        dh = a[:, None] * dz[bag] + dleft @ p["V"].T + dright @ p["U"].T
        dpre = dh * (1 - h**2)
        return {
            "W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dleft, "U": h.T @ dright,
            "w": (left * right).T @ de, "c": s["z"].T @ dl, "c0": np.array([dl.sum()]),
        }


def fit(
    x: np.ndarray, begins: np.ndarray, y: np.ndarray,
    epochs: int = 25, batch: int = 64, rate: float = 0.005, decay: float = 1e-5, seed: int = 7,
) -> BagModel:
    """Adam on bags of passages, in a seeded order."""
    model = BagModel.fresh(seed)
    rng = np.random.default_rng(seed)
    sizes = np.diff(np.r_[begins, len(x)])
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            rows = np.concatenate([np.arange(begins[k], begins[k] + sizes[k]) for k in bags])
            starts = np.r_[0, np.cumsum(sizes[bags])[:-1]]
            step += 1
            for k, g in model.gradients(x[rows].astype(float), starts, y[bags]).items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                up = first[k] / (1 - 0.9**step)
                model.weights[k] -= rate * up / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> BagModel | None:
    """Fit on at most ``sample_rows`` labelled keys, those of the lowest hashes.

    Several labels of a key count as their majority (ties as 1); NULL keys and
    labels are skipped.  Executors compute passage features of the sampled rows;
    the driver gets those and fits.  Without any labelled row the result is
    ``None``, with which every document scores 0.5.
    """
    require_text(df, text)
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
        .dropna()
        .groupBy("key")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample_rows)
    )
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Bounded by sample_rows pairs of numbers.
    rows = rows.join(F.broadcast(chosen), "key").withColumn("rank", F.xxhash64("key", "text"))

    def encode(batches):
        for frame in batches:
            x, owner = passages(frame["text"].tolist())
            begins = np.searchsorted(owner, np.arange(len(frame) + 1))
            blobs = [x[a:b].tobytes() for a, b in zip(begins, begins[1:])]
            yield pd.DataFrame({"rank": frame["rank"], "y": frame["y"], "x": blobs})

    bags = rows.mapInPandas(encode, "rank long, y double, x binary").orderBy("rank", "y")
    # Repeated keys cannot lift the number of bags over the bound.
    found = bags.limit(sample_rows).toPandas()
    if not len(found):
        return None
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"]]
    begins = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    return fit(np.concatenate(parts), begins, found["y"].to_numpy())


def score(
    df: DataFrame, model: BagModel | None, key: str = "doc_id", text: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """``key``, ``score`` and ``predicted`` of every row, from its whole text.

    NULL counts as empty; an empty text is scored as one passage without
    features.  Repeated and NULL keys are rows of their own, an empty table
    gives an empty one, other columns are ignored.
    """
    require_text(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        def answer(texts):
            p = probabilities(shared.value, texts)
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return answer

    return per_text(df, key, text, "score double, predicted int", start)


def accepted(df: DataFrame, model: BagModel | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns, that score ``threshold`` or more.

    Without a model nothing is rejected.
    """
    require_text(df, text)
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_texts(df, text, lambda: lambda texts: probabilities(shared.value, texts) >= threshold)


def probabilities(model: BagModel | None, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x, owner = passages(texts)
    return model.forward(x.astype(float), np.searchsorted(owner, np.arange(len(texts))))["p"]
