"""Dealing whole groups to folds so that every class is spread evenly.

Groups stand in the order of their count of the first class, and each run of
``n_folds`` groups gives every fold one.  Whatever the order inside the runs, folds then
differ in that class by at most its largest count in a group: the differences inside
the runs telescope.  The order inside a run is free for the second class: the fold
with the least of it gets the most, so the folds' spread never grows beyond the
largest one of a run.  With further classes the one whose matching leaves all of
them most even decides.

Partial deals are merged in the same way, labels against labels, so chunks of
runs are dealt in parallel and only their loads meet, again in chunks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.plans.ordering import with_row_index
from foldwise.plans.small import attach, settle
from foldwise.session import cut_lineage

# Deals merged in one task.
FAN = 4096


def matched(load: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each fold the row of ``more`` that it gets; both are (folds, classes)."""
    best, least = None, np.inf
    weight = 1.0 / np.maximum(load.sum(axis=0) + more.sum(axis=0), 1)
    for c in range(1, load.shape[1]) or [0]:
        given = np.empty(len(load), np.int64)
        given[np.argsort(load[:, c], kind="stable")] = np.argsort(-more[:, c], kind="stable")
        uneven = float((np.ptp(load + more[given], axis=0) * weight).max())
        if uneven < least:
            best, least = given, uneven
    return best


def merge(deals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New labels of each deal's folds, and the loads together; deals are (n, folds, classes)."""
    load = deals[0].copy()
    labels = np.empty(deals.shape[:2], np.int64)
    labels[0] = np.arange(len(load))
    for i in range(1, len(deals)):
        given = matched(load, deals[i])
        labels[i, given] = np.arange(len(load))
        load += deals[i][given]
    return labels, load


def deal(groups: DataFrame, counts: str, order: list[Column], n_folds: int) -> DataFrame:
    """``groups`` with a ``__fold``; ``counts`` is an array of a group's rows per class.

    ``order`` is total and begins with the first class's count, descending.
    """
    placed = with_row_index(groups, order, "__place").withColumn(
        "__chunk", F.floor(F.col("__place") / (n_folds * FAN)).cast("long")
    )
    placed = cut_lineage(placed)
    narrow = placed.select("__chunk", F.col("__place").alias("__item"), F.array(F.col(counts)).alias("__loads"))
    found = _merged(narrow, n_folds, runs=True)
    label = F.element_at("__labels", 1)
    dealt = attach(placed, found.where("__item IS NOT NULL").select("__item", label.alias("__fold")).withColumnRenamed("__item", "__place"), ["__place"], ["__fold"])
    while True:
        loads = found.where("__item IS NULL").select(F.col("__chunk").alias("__item"), "__loads")
        if loads.count() <= 1:
            return dealt.drop("__place", "__chunk")
        above = loads.withColumn("__chunk", F.floor(F.col("__item") / FAN).cast("long"))
        found = _merged(above.select("__chunk", "__item", "__loads"), n_folds, runs=False)
        maps = settle(found.where("__item IS NOT NULL").select(F.col("__item").alias("__chunk"), "__labels"))
        dealt = attach(dealt, maps, ["__chunk"], ["__labels"])
        dealt = dealt.withColumn("__fold", F.element_at("__labels", F.col("__fold") + 1)).drop("__labels")
        dealt = dealt.withColumn("__chunk", F.floor(F.col("__chunk") / FAN).cast("long"))


def _merged(items: DataFrame, n_folds: int, runs: bool) -> DataFrame:
    """(__chunk, __item, __labels, __loads): each item's labels, and a row of loads per chunk.

    With ``runs`` an item is a single group, ``n_folds`` consecutive ones make a deal.
    """

    def one(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("__item")
        loads = np.array([np.stack(m) for m in chunk["__loads"]], np.int64)
        if runs:
            loads = loads[:, 0, :]
            pad = -len(loads) % n_folds
            loads = np.concatenate([loads, np.zeros((pad, loads.shape[1]), np.int64)])
            loads = loads.reshape(-1, n_folds, loads.shape[1])
        labels, load = merge(loads)
        each = labels.reshape(-1, 1)[: len(chunk)] if runs else labels
        name = int(chunk["__chunk"].iloc[0])
        return pd.DataFrame({
            "__chunk": name,
            "__item": pd.array([*chunk["__item"].tolist(), None], dtype="Int64"),
            "__labels": [*each.tolist(), None],
            "__loads": [*[None] * len(chunk), load.tolist()],
        })

    kinds = "__chunk long, __item long, __labels array<int>, __loads array<array<long>>"
    return cut_lineage(items.groupBy("__chunk").applyInPandas(one, kinds))
