"""Outputs (S5-S8, S10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.operators.columns import select_columns
from foldwise.operators.ensemble import output_tables
from foldwise.plans.small import total_bytes
from foldwise.sources.readers import check_separate

FOLD_LAYOUTS = ("assigned", "exploded")
# Bytes of rows, not compressed, that one task sorts and writes into a partition.
TASK_BYTES = 64 << 20


def write_table(
    df: DataFrame, output_dir: str, node_id: str, columns: Sequence[str], inputs: Sequence[str] = ()
) -> str:
    """Selected columns, not split: ``{output_dir}/{node_id}/test.parquet``.

    This and the other writers refuse an output that overlaps with one of ``inputs`` (S4).
    """
    check_separate(inputs, output_dir)
    path = f"{output_dir}/{node_id}/test.parquet"
    select_columns(df, columns).write.mode("overwrite").parquet(path)
    return path


def write_folds(
    df: DataFrame,
    output_dir: str,
    node_id: str,
    columns: Sequence[str],
    fold_col: str = "fold",
    layout: str = "assigned",
    n_splits: int | None = None,
    inputs: Sequence[str] = (),
) -> str:
    """Write the table once, partitioned by fold.

    Readers pick a side with ``read_fold``, which prunes partitions.  The
    ``exploded`` layout writes every row ``n_splits`` times under
    ``fold=i/split=train|test`` for readers that want plain directories.
    """
    if layout not in FOLD_LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known: {FOLD_LAYOUTS}")
    check_separate(inputs, output_dir)
    path = f"{output_dir}/{node_id}"
    rows = select_columns(df, list(dict.fromkeys([*columns, fold_col])))
    if layout == "assigned":
        _dealt(rows, [fold_col]).write.mode("overwrite").partitionBy(fold_col).parquet(path)
        return path
    if n_splits is None:
        raise ValueError("the exploded layout needs n_splits")
    own = F.col(fold_col).alias("__own")
    spread = rows.select(
        *[c for c in rows.columns if c != fold_col],
        own,
        F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"),
    )
    side = F.when(F.col("fold") == F.col("__own"), "test").otherwise("train")
    sides = _dealt(spread.withColumn("split", side).drop("__own"), ["fold", "split"])
    sides.write.mode("overwrite").partitionBy("fold", "split").parquet(path)
    return path


def _dealt(rows: DataFrame, sides: Sequence[str]) -> DataFrame:
    """``rows`` with every side in as few tasks as take ``TASK_BYTES`` each, so in few files.

    Shuffled bytes say little about what a task sorts, as ascending keys and repeated
    folds shrink to a fraction, so sizes are summed beforehand: one row per side comes
    to the driver.  Inside a side rows are dealt by a hash of their columns.
    """
    sizes = rows.groupBy(*sides).agg(total_bytes(rows).alias("__size")).collect()
    hashed = [c for c, kind in rows.dtypes if c not in sides and "map<" not in kind and "variant" not in kind]
    mixed = F.xxhash64(*hashed) if hashed else F.lit(0)
    place, tasks = F, 0
    for found in sizes:
        parts = -(-found["__size"] // TASK_BYTES) or 1
        here = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.lit(found[s])) for s in sides])
        place = place.when(here, F.lit(tasks) + F.pmod(mixed, F.lit(parts)).cast("int"))
        tasks += parts
    return rows.repartitionById(tasks, place.otherwise(0)) if sizes else rows


def read_fold(
    spark: SparkSession, path: str, fold: int, split: str, fold_col: str = "fold"
) -> DataFrame:
    """Train or test rows of one fold, from either layout."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    table = spark.read.parquet(path)
    if "split" in table.columns:
        return table.where((F.col("fold") == fold) & (F.col("split") == split))
    side = F.col(fold_col) == fold if split == "test" else F.col(fold_col) != fold
    return table.where(side)


def write_predictions(
    predictions: DataFrame,
    output_dir: str,
    id_col: str,
    target_name: str,
    threshold: float | None = None,
    inputs: Sequence[str] = (),
) -> dict[str, str]:
    """CSV of the final output; with a threshold both labels and probabilities."""
    check_separate(inputs, output_dir)
    paths = {}
    for name, table in output_tables(predictions, id_col, target_name, threshold).items():
        paths[name] = f"{output_dir}/{name}.csv"
        table.write.mode("overwrite").option("header", True).csv(paths[name])
    return paths


def write_statistics(
    df: DataFrame, path: str, output_format: str = "parquet", inputs: Sequence[str] = ()
) -> str:
    """A profile table as parquet or csv."""
    check_separate(inputs, path)
    if output_format not in ("parquet", "csv"):
        raise ValueError(f"unknown output format {output_format!r}")
    writer = df.write.mode("overwrite")
    full = f"{path}.{output_format}"
    if output_format == "parquet":
        writer.parquet(full)
    else:
        writer.option("header", True).csv(full)
    return full


RUN_TABLES = {
    "runs": "run_ts string, job_id string, kind string, commit string, seed bigint",
    "run_steps": "run_ts string, step_id string, method string, status string, reason string",
    "fold_scores": "run_ts string, fold int, train_score double, valid_score double",
}


def record_run(
    spark: SparkSession,
    root: str,
    run: Mapping[str, object],
    steps: Sequence[Mapping[str, object]] = (),
    fold_scores: DataFrame | None = None,
) -> None:
    """Append one run, its step outcomes and fold scores to the run tables.

    Tables are partitioned by ``run``, a copy of ``run_ts``, so that the newest run
    is read alone.
    """

    def append(name: str, table: DataFrame) -> None:
        table.withColumn("run", F.col("run_ts")).write.mode("append").partitionBy("run").parquet(f"{root}/{name}")

    def table(name: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
        fields = [f.split()[0] for f in RUN_TABLES[name].split(", ")]
        values = [tuple(row.get(f) for f in fields) for row in rows]
        return spark.createDataFrame(values, RUN_TABLES[name])

    append("runs", table("runs", [run]))
    if steps:
        append("run_steps", table("run_steps", [{"run_ts": run["run_ts"], **s} for s in steps]))
    if fold_scores is not None:
        scores = fold_scores.select(
            F.lit(run["run_ts"]).alias("run_ts"),
            F.col("fold").cast("int").alias("fold"),
            F.col("train_score").cast("double").alias("train_score"),
            F.col("valid_score").cast("double").alias("valid_score"),
        )
        append("fold_scores", scores)
