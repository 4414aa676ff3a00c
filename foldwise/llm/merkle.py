"""Merkle manifest of a dataset with proofs folded by a recursive query (operator 13).

Rows are leaves, in one binary tree per partition value; the trees' roots are the
leaves of one more tree.  Levels are built from the bottom, ``STRIDE`` at a time,
and stored as parent-linked node rows: a node knows its ancestor ``STRIDE`` levels
up and the siblings on the way there.  A Spark recursive query then ascends from
every leaf, appends the siblings and folds the hash that the leaf is to be checked
with.  Everything is DataFrame and SQL code.

The ``2**STRIDE`` nodes of a block are the largest group that meets in a task.
The upper stored levels, as far as they are small together, are broadcast; those
below join by shuffle, where the leaves under a node are few against all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from foldwise.llm.common import sized, stored
from foldwise.plans.small import BROADCAST_BYTES, VALUE_BYTES, broadcast_within

# Tree levels between stored ones, so 256 nodes in a block.
STRIDE = 8
# The tree over the other trees' roots; other trees' names begin with "-" or "=".
_TOP = ""
# Equal rows are spread over so many places of a range order.
_SALTS = 4096
# A node row: its siblings and its other columns, but for the tree's name.
_NODE_BYTES = STRIDE * (32 + VALUE_BYTES) + 8 * VALUE_BYTES

# The recursion stops with an error beyond a number of rows that is made for small results.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

# One step: from a node to its ancestor in the next stored level.
_FOLD = """reduce(n.siblings, named_struct('hash', {hash}, 'at', n.at), (a, s) -> named_struct(
  'hash', sha2(if(a.at % 2 = 1, concat(lower(hex(s)), a.hash), concat(a.hash, lower(hex(s)))), 256),
  'at', shiftright(a.at, 1)), a -> a.hash)"""
_JOINED = "reduce(n.siblings, {proof}, (p, s) -> concat(p, s))"
_SUBROOT = "if(n.up_level = -1, n.up_hash, {subroot})"
_CLIMB = f"""
WITH RECURSIVE climb (key, leaf, subroot, root, proof, folded, up_tree, up_level, up_place) AS (
  SELECT key, leaf, subroot, root, proof, folded, up_tree, up_level, up_place FROM {{paths}}
  UNION ALL
  SELECT c.key, c.leaf, {_SUBROOT.format(subroot="c.subroot")}, n.up_hash,
    {_JOINED.format(proof="c.proof")}, {_FOLD.format(hash="c.folded")}, n.up_tree, n.up_level, n.up_place
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.place = c.up_place
)
SELECT * FROM climb"""


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes of a text, in lower-case hexadecimal digits."""
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """A value that cannot be confused with its neighbours: byte count, colon, text; "-" if NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(v) for v in values]))


def manifest(
    df: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    partition: str = "lang",
    checked: Column | None = None,
) -> DataFrame:
    """Every row's ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of the row's ``columns``.  The leaves of a ``partition``
    value ascend by ``key`` (NULL first; repeated keys by leaf); while several
    nodes remain, each two consecutive ones become their digest, a last single one
    its own.  Subroots, NULL first and then in the order of the value's text by
    bytes, become the root in the same way.

    ``checked`` is the digest that a row is verified with, an expression of columns
    of ``df``; where it is NULL, or not given, that is the leaf.  ``folded_root``
    folds it with the leaf's own siblings, and ``verified`` says whether it equals
    ``root``.  ``proof_sha256`` is the digest of the siblings from the leaf upwards.

    The result is a written table.  Besides ``key`` no column of ``df`` is returned;
    others are not looked at unless ``checked`` does.  Rows that repeat in all
    columns are leaves of their own, NULLs, empty and long texts are values like any
    other, and an empty table gives an empty one.  A key with the name of a result
    raises ``ValueError``.
    """
    results = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if key.lower() in results:
        raise ValueError(f"key {key} has the name of a result; rename it")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{partition}`").cast("string")), F.lit("-"))
    leaf = row_digest([F.col(f"`{c}`") for c in columns])
    tried = checked if checked is not None else F.lit(None).cast("string")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")
    rows = stored(
        df.select(
            tree.alias("tree"), F.col(f"`{key}`").alias("key"), leaf.alias("hash"),
            tried.alias("checked"), salt.alias("salt"),
        ),
        "leaves",
    )
    levels, subroots = _built(*_numbered(rows, ["key", "hash", "salt"]), ["key", "checked"])
    names = subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "hash")
    top_levels, _ = _built(*_numbered(names, ["name"]), ["name"])

    # Where a tree ends, the way goes on from its name among the leaves of the top tree.
    entries = _nodes(top_levels[0], -1, ["name"]).withColumns(
        {"tree": F.col("name"), "place": F.lit(0).cast("long")}
    )
    above = [(i, blocks, _nodes(blocks, i)) for i, blocks in enumerate(levels) if i]
    above.append((-1, top_levels[0], entries.drop("name")))
    above += [(-i - 1, blocks, _nodes(blocks, -i - 1)) for i, blocks in enumerate(top_levels) if i]

    low, high, size = [], [], 0
    for number, blocks, nodes in reversed(above):
        width = _NODE_BYTES * F.size("items") + F.octet_length("tree") * F.size("items") * 2
        if number == -1:
            width += F.reduce("items", F.lit(0), lambda s, x: s + 2 * F.octet_length(x["name"]))
        size += blocks.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("s")).first()["s"]
        (high if size <= BROADCAST_BYTES and not low else low).append((number, nodes))

    paths = _start(_nodes(levels[0], 0, ["key", "checked", "hash"]))
    spark = df.sparkSession
    with _unlimited(spark):
        if low:
            nodes = stored(_union([n for _, n in low]), "nodes")
            # Nodes of several stored levels are met at once, each by its own leaves only.
            found = spark.sql(_CLIMB, paths=paths, nodes=nodes)
            done = F.col("up_tree").isNull() | ~F.col("up_level").isin([i for i, _ in low])
            paths = stored(found.where(done), "paths")
        if high:
            nodes = broadcast_within(stored(_union([n for _, n in high]), "nodes"), 0)
            found = spark.sql(_CLIMB, paths=paths, nodes=nodes)
        else:
            found = paths
        return stored(
            found.where("up_tree IS NULL").select(
                F.col("key").alias(key), "leaf", "subroot", "root",
                digest(F.lower(F.hex("proof"))).alias("proof_sha256"),
                F.col("folded").alias("folded_root"),
                (F.col("folded") == F.col("root")).alias("verified"),
            ),
            "manifest",
        )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursive queries of any number of rows."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``place`` in their ``tree``, and the trees' sizes ``n``.

    Range partitions of the whole order, written; a tree's rows in a partition are
    numbered there and begin at the number of its rows in earlier partitions.
    Equal rows may change places, which changes no hash.
    """
    full = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    ranged = rows.repartitionByRange(*full).sortWithinPartitions(*full)
    tag = F.monotonically_increasing_id()  # the partition, and the row in it
    laid = stored(ranged.withColumn("tag", tag), "ranges").withColumn("part", F.shiftright("tag", 33))
    # A row per tree and partition that holds rows of it.
    spans = laid.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"), F.min("tag").alias("first"))
    spans = stored(spans, "spans")
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")
    begins = sized(stored(spans.select("tree", "part", begin.alias("begin")), "begins"))
    placed = laid.join(begins, ["tree", "part"]).withColumn("place", F.col("begin") + F.col("tag"))
    sizes = sized(stored(spans.groupBy("tree").agg(F.sum("c").alias("n")), "sizes"))
    return placed, sizes


def _pairs(hashes: Column) -> Column:
    """The next level of an array of hashes."""
    last = F.shiftright(F.size(hashes) - 1, 1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: digest(F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit("")))),
    )


def _built(
    placed: DataFrame, sizes: DataFrame, carried: list[str]
) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels, as blocks, from the bottom; and (tree, hash) of the trees' roots.

    A block is (tree, block, n, items, levels): up to ``2**STRIDE`` neighbours of a
    level with their hashes, the hashes of the levels above them inside the block, and
    the number of the level's nodes.  Level 0 has ``carried`` columns in its items.
    """
    found, roots = [], []
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    rows = placed.select("tree", "place", "hash", *carried)
    while True:
        item = F.struct("place", "hash", *(carried if not found else []))
        blocks = rows.groupBy("tree", F.shiftright("place", STRIDE).alias("block")).agg(
            F.sort_array(F.collect_list(item)).alias("items")
        )
        blocks = blocks.join(sizes, "tree")
        levels = F.reduce(
            F.sequence(F.lit(1), F.lit(STRIDE)),
            F.array(F.transform("items", lambda x: x["hash"])),
            lambda done, i: F.when(
                i <= _rounds(F.col("n")), F.array_append(done, _pairs(F.element_at(done, -1)))
            ).otherwise(done),
        )
        blocks = stored(blocks.withColumn("levels", levels), "blocks")
        found.append(blocks)
        up = blocks.select("tree", "n", F.col("block").alias("place"), _last_hash().alias("hash"))
        roots.append(up.where(F.col("n") <= 1 << STRIDE).select("tree", "hash"))
        if most <= 1 << STRIDE:
            return found, _union(roots)
        most = (most + (1 << STRIDE) - 1) >> STRIDE
        rows = up.where(F.col("n") > 1 << STRIDE).drop("n")
        sizes = sizes.withColumn("n", F.shiftright(F.col("n") + (1 << STRIDE) - 1, STRIDE))


def _rounds(n: Column) -> Column:
    """Levels from ``n`` nodes to a single one, at most ``STRIDE``."""
    return F.when(n > 1, F.least(F.length(F.bin(n - 1)), F.lit(STRIDE))).otherwise(0)


def _last_hash() -> Column:
    return F.get(F.element_at("levels", -1), F.lit(0))


def _nodes(blocks: DataFrame, level: int, carried: Sequence[str] = ()) -> DataFrame:
    """Every node of a level: its siblings on the way to the next stored level, and where that leads.

    ``siblings`` is empty bytes where there is none; a bit of ``at`` says that the
    sibling comes first.  The way leads to node (up_tree, up_level, up_place), whose
    hash is ``up_hash``: to level -1 after a tree's root, nowhere (NULL) after the top one.
    """
    inside = F.col("n") > 1 << STRIDE
    way = F.transform(
        F.sequence(F.lit(0), F.lit(STRIDE - 1)),
        lambda k: F.coalesce(
            F.unhex(
                F.get(F.get("levels", k), F.call_function("shiftright", F.col("at"), k).bitwiseXOR(F.lit(1)))
            ),
            F.lit(b""),
        ),
    )
    rows = blocks.select("*", F.posexplode("items").alias("at", "item"))
    over = (level if level < 0 else -level) - 1  # of the top tree
    return rows.select(
        "tree",
        F.lit(level).alias("level"),
        F.col("item.place").alias("place"),
        *[F.col(f"item.{c}").alias(c) for c in carried],
        "at",
        F.slice(way, F.lit(1), _rounds(F.col("n"))).alias("siblings"),
        F.when(inside | (F.col("tree") != _TOP), F.col("tree")).alias("up_tree"),
        F.when(inside, F.lit(level + 1 if level >= 0 else over))
        .when(F.col("tree") != _TOP, F.lit(-1)).alias("up_level"),
        F.when(inside, F.col("block")).otherwise(F.lit(0)).cast("long").alias("up_place"),
        _last_hash().alias("up_hash"),
    )


def _start(leaves: DataFrame) -> DataFrame:
    """The first step of every leaf's way, which its own block knows."""
    tried = "coalesce(n.checked, n.hash)"
    return leaves.alias("n").selectExpr(
        "n.key", "n.hash AS leaf", _SUBROOT.format(subroot="CAST(NULL AS STRING)") + " AS subroot",
        "n.up_hash AS root", _JOINED.format(proof="X''") + " AS proof",
        _FOLD.format(hash=tried) + " AS folded", "n.up_tree", "n.up_level", "n.up_place",
    )
