"""Near-duplicate vectors by PCA-ordered tiled comparison (operator 9).

Vectors are rotated onto their principal axes, so that a few leading dimensions
hold most of a product.  Tiles of vectors from neighbouring cells of the leading
axes are compared: partial products are accumulated axis block by axis block,
and what is left is bounded by the product of the suffix norms.  A tile pair
stops when no pair in it can reach the threshold any more.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.llm.common import sized, stored
from foldwise.llm.components import components

TILE = 2048
PANEL = 8  # tiles a panel; a task holds two panels at a time
CELL_AXES = 4
STEP = 16  # axes between two bounds
_SLACK = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector can link: not NULL, not zero, only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither over- nor underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """Axes (columns) by falling second moment, over all vectors of ``classes``.

    Tasks send size^2 sums, which Spark adds up; the driver gets size^2 numbers.
    """

    def moments(batches):
        total = np.zeros((size, size))
        for frame in batches:
            x = _unit(_matrix(frame["v"]))
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    parts = classes.select("v").mapInPandas(moments, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    matrix = np.zeros((size, size))
    found = cells.toPandas()
    matrix[found["i"], found["j"]] = found["x"]
    values, vectors = np.linalg.eigh(matrix)
    return vectors[:, np.argsort(-values)]


def _linked(a: dict, b: dict, threshold: float) -> np.ndarray | None:
    """Mask of the pairs with a cosine of ``threshold`` or more, None if there are none."""
    size = a["y"].shape[1]
    product = np.zeros((len(a["y"]), len(b["y"])))
    for k in range(0, size, STEP):
        end = min(size, k + STEP)
        product += a["y"][:, k:end] @ b["y"][:, k:end].T
        if end < size:
            bound = product + np.outer(a["rest"][end], b["rest"][end])
            if bound.max() < threshold - _SLACK:
                return None
    mask = product >= threshold
    # Rotated products differ in the last digits: settle those pairs on the vectors given.
    i, j = np.nonzero(np.abs(product - threshold) < _SLACK)
    if len(i):
        x, y = a["v"][i], b["v"][j]
        exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        mask[i, j] = exact >= threshold
    return mask if mask.any() else None


def _spread(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label each row and column reaches over the links of one tile pair."""
    none = np.iinfo(np.int64).max
    while True:
        low = np.minimum(left, np.where(mask, right[None, :], none).min(1))
        high = np.minimum(right, np.where(mask, low[:, None], none).min(0))
        if (low == left).all() and (high == right).all():
            return low, high
        left, right = low, high


def _tiles(classes: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """Tiles of at most ``TILE`` vectors of one cell, with their box on all axes."""
    size = len(axes)
    leading = min(CELL_AXES, size)

    def place(batches):
        for frame in batches:
            y = _unit(_matrix(frame["v"])) @ axes[:, : leading + 1]
            frame["cell"] = list(np.floor(y[:, :leading] / width).astype(np.int32))
            frame["along"] = y[:, -1]
            yield frame

    placed = classes.mapInPandas(place, f"{_ddl(classes)}, cell array<int>, along double")
    # The last sort columns split a cell of any size over partitions.
    ranged = placed.repartitionByRange("cell", "along", "id").sortWithinPartitions("cell", "along", "id")

    def cut(batches: Iterator[pd.DataFrame]):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        number = itertools.count()
        held: list[pd.DataFrame] = []

        def tile(frame: pd.DataFrame) -> dict:
            n = next(number)
            v = _matrix(frame["v"])
            y = _unit(v) @ axes
            return {
                "tile": base + n, "panel": base + n // PANEL, "cell": frame["cell"].iloc[0],
                "low": y.min(0), "high": y.max(0), "ids": frame["id"].to_numpy(),
                "weights": frame["n"].to_numpy(), "v": v.tobytes(),
            }

        def ready(frame: pd.DataFrame, last: bool) -> Iterator[dict]:
            cells = frame["cell"].map(tuple)
            groups = (cells != cells.shift()).cumsum()
            for group, rows in frame.groupby(groups, sort=False):
                if group == groups.iloc[-1] and not last:
                    whole = len(rows) // TILE * TILE
                    held.append(rows.iloc[whole:])
                    rows = rows.iloc[:whole]
                for k in range(0, len(rows), TILE):
                    yield tile(rows.iloc[k : k + TILE])

        for frame in batches:
            if len(frame):
                rows = pd.concat([*held, frame], ignore_index=True)
                held.clear()
                out = list(ready(rows, False))
                if out:
                    yield pd.DataFrame(out)
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(rows):
            yield pd.DataFrame(list(ready(rows, True)))

    return ranged.mapInPandas(
        cut,
        "tile long, panel long, cell array<int>, low array<double>, high array<double>, "
        "ids array<long>, weights array<long>, v binary",
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _tile_pairs(tiles: DataFrame, leading: int, reach: float) -> DataFrame:
    """Pairs of tiles in the same or neighbouring cells whose boxes are near enough."""
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=leading) if o >= (0,) * leading]
    listed = F.array(*[F.array(*map(F.lit, o)) for o in offsets])
    left = tiles.select("tile", "panel", "low", "high", "cell", F.explode(listed).alias("step")).select(
        F.col("tile").alias("l"), F.col("panel").alias("pl"), "low", "high",
        F.zip_with("cell", "step", lambda c, s: c + s).alias("at"),
        F.exists("step", lambda s: s != 0).alias("away"),
    )
    right = tiles.select(
        F.col("tile").alias("r"), F.col("panel").alias("pr"), F.col("low").alias("low_r"),
        F.col("high").alias("high_r"), F.col("cell").alias("at"),
    )
    gap = F.zip_with(
        F.zip_with("low", "high_r", lambda x, y: x - y),
        F.zip_with("low_r", "high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    near = left.join(right, "at").where((F.col("away") | (F.col("l") <= F.col("r"))) & (apart <= reach))
    return near.select("l", "pl", "r", "pr")


def _links(classes: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Weighted link counts, and links that span the components, of distinct vectors."""
    axes = principal_axes(classes, size)
    # Unit vectors with a cosine of t are sqrt(2 - 2t) apart, and no further on any axis.
    reach = 2 - 2 * threshold + _SLACK
    width = max(1e-3, math.sqrt(reach))
    tiles = stored(_tiles(classes, axes, width), "tiles")
    pairs = stored(_tile_pairs(tiles.drop("ids", "weights", "v"), min(CELL_AXES, size), reach), "tile-pairs")
    # A task gets two panels of tiles at most, and the pairs among them.
    partners = pairs.groupBy("pl", "pr", F.col("l").alias("tile")).agg(F.collect_set("r").alias("partners"))
    others = pairs.select("pl", "pr", F.col("r").alias("tile"), F.array().cast("array<long>").alias("partners"))
    needed = partners.unionByName(others).groupBy("pl", "pr", "tile").agg(
        F.flatten(F.collect_set("partners")).alias("partners")
    )
    rows = needed.join(tiles.select("tile", "ids", "weights", "v"), "tile")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for row in frame.itertuples():
            v = np.frombuffer(row.v).reshape(len(row.ids), size)
            y = _unit(v) @ axes
            squares = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
            rest = {k: np.sqrt(squares[:, k]) for k in range(STEP, size, STEP)}
            held[row.tile] = {"v": v, "y": y, "rest": rest, "ids": np.asarray(row.ids),
                              "w": np.asarray(row.weights), "n": np.zeros(len(v), np.int64),
                              "root": np.asarray(row.ids).copy()}
        out = []
        for row in frame.itertuples():
            for other in sorted(row.partners):
                a, b = held[row.tile], held[other]
                mask = _linked(a, b, threshold)
                if mask is None:
                    continue
                if row.tile == other:
                    np.fill_diagonal(mask, False)
                a["n"] += mask @ b["w"]
                if row.tile != other:
                    b["n"] += a["w"] @ mask
                low, high = _spread(mask, a["ids"], b["ids"])
                for ids, roots in ((a["ids"], low), (b["ids"], high)):
                    moved = roots != ids
                    out.append(pd.DataFrame({"id": ids[moved], "root": roots[moved], "n": 0}))
        for t in held.values():
            some = t["n"] > 0
            out.append(pd.DataFrame({"id": t["ids"][some], "root": t["ids"][some], "n": t["n"][some]}))
        if not out:
            return pd.DataFrame({"id": [], "root": [], "n": []}).astype("int64")
        return pd.concat(out).astype("int64")

    found = stored(rows.groupBy("pl", "pr").applyInPandas(compare, "id long, root long, n long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_other"))
    return counts, found.where("id != root").select("id", "root")


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """Links of cosine >= ``threshold`` (above 0), whole and exact in double precision.

    One row per vector: ``key``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest key reachable over links, its own included) and
    ``kept`` (whether the key is that one).  Equal vectors are one class with a
    count, so copies are never expanded into pairs.  Vectors that are NULL,
    empty, zero or hold NULL or non-finite components link with nothing, not
    even with their copies; vectors of different lengths do not link.  Repeated
    keys are vectors of their own; a NULL key takes part, but is no component's
    id (a component without any other has NULL) and is not kept.  An empty table
    gives an empty one; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.where(usable("v"))
    marks = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    # 128 bits of the vector stand for it; -0.0 counts as 0.0.
    good = good.withColumn("v", F.transform("v", lambda x: x + 0.0)).select("key", "v", *marks)
    classes = good.groupBy("h1", "h2").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least")
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = [_links(classes.where(F.size("v") == s).select("id", "v", "n"), s, threshold) for s in sorted(sizes)]
    state = classes.select("id", "h1", "h2", "n", "least")
    if found:
        counts, links = found[0]
        for more_counts, more_links in found[1:]:
            counts, links = counts.unionByName(more_counts), links.unionByName(more_links)
        roots = sized(stored(components(links, "id", "root"), "vector-roots"))
        state = state.join(counts, "id", "left").join(roots, "id", "left")
    else:
        state = state.withColumns({"n_other": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    state = stored(
        state.select(
            "h1", "h2", "least", F.coalesce("root", "id").alias("root"),
            (F.coalesce("n_other", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "vector-state",
    )
    smallest = sized(stored(state.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least"))
    state = sized(stored(state.join(smallest, "root").select("h1", "h2", "n_links", "component_id"), "vector-ends"))
    linked = good.select("key", "h1", "h2").join(state, ["h1", "h2"]).drop("h1", "h2")
    alone = rows.where(~usable("v")).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("key").cast(kind).alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
