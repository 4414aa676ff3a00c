"""Connected components by distributed union-find on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import is_empty, sized, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` of every id in ``links``: equal roots, same component.

    Ids are whole numbers.  In each round every id hooks onto the first of its
    neighbours and itself in an order by hash, and links are contracted to the
    ends' parents, until none is left; hashing makes the number of rounds
    logarithmic even for chains.  A round shuffles once; parents are broadcast
    where their measured size allows.  Neighbours are reduced by a minimum, so an id
    with very many links is combined before it is shuffled and never gathered.
    Rounds are written tables.  Loops and repeated links do no harm; rows with
    a NULL end are ignored; no links give an empty table.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = stored(ends.dropna(), "links")
    rounds: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        parents = both.groupBy("a").agg(F.min(order).alias("least")).select(
            F.col("a").alias("id"), F.least("least", own)["id"].alias("parent")
        )
        parents = sized(stored(parents, "parents"))
        rounds.append(parents)
        left = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        contracted = edges.join(left, "a").join(right, "b").where("pa != pb")
        edges = stored(contracted.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "links")
        if is_empty(edges):
            break
    found = rounds[-1].withColumnRenamed("parent", "root")
    for parents in reversed(rounds[:-1]):
        roots = found.select(F.col("id").alias("parent"), "root")
        found = parents.join(roots, "parent", "left").select(
            "id", F.coalesce("root", "parent").alias("root")
        )
    return found
