"""Input tables."""

from __future__ import annotations

import csv
import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import islice
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foldwise.operators.media import list_images
from foldwise.session import cut_lineage

Schema = StructType | str


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: Schema | None = None
) -> DataFrame:
    """CSV with a header; without a schema, types are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with its own schema."""
    return spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """One JSON object per line (O2)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def csv_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """A file as itself, a directory as its sorted ``*.csv`` files, not deeper (S3)."""
    found: list[str] = []
    for path in paths:
        status = _status(spark, path)
        if not status.isDirectory():
            found.append(path)
            continue
        children = [s.getPath() for s in _children(spark, path) if not s.isDirectory()]
        found += sorted(str(p.toString()) for p in children if p.getName().endswith(".csv"))
    return found


def read_csv_directory(
    spark: SparkSession, path: str, schema: Schema | None = None, file_col: str = "source_file"
) -> DataFrame:
    """All CSV files of one schema at once, each row tagged with its file's path (S3)."""
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias(file_col))


# Larger than any file: a scan with this setting has one task per file.
_ONE_FILE = str(1 << 50)
# Headers that one job looks up.
_HEADERS_A_JOB = 200
# Files of one read; a header that more files share takes several reads.
_FILES_A_READ = 10_000


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def csv_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, header): the first line of every file that is not empty, as written tables.

    A task per file takes its first line and stops, so only a file's first buffer is
    read.  Jobs have ``_HEADERS_A_JOB`` such tasks.
    """
    files = spark.read.format("binaryFile").load(pattern).where("length > 0").select("path").orderBy("path")
    listed, found = files.toLocalIterator(), []
    with _settings(spark, spark__sql__files__maxPartitionBytes=_ONE_FILE):
        while paths := [r["path"] for r in islice(listed, _HEADERS_A_JOB)]:
            # Names are taken as they are, not as patterns.
            first = [
                spark.read.text(_escaped(p)).limit(1).select(F.lit(p).alias("path"), F.col("value").alias("header"))
                for p in paths
            ]
            found.append(cut_lineage(reduce(DataFrame.unionByName, first)))
    if not found:
        raise ValueError(f"no rows in files matching {pattern!r}")
    return reduce(DataFrame.unionByName, found)


def _escaped(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_csv_glob(spark: SparkSession, pattern: str, schema: Schema | None = None) -> DataFrame:
    """CSV files matching a pattern, one below the other; columns match by name (O1).

    With a schema its columns are returned, NULL where a file lacks one; columns
    of a file that the schema does not name are left out.  Files that share a header
    are read together: all files by the pattern if there is one header, else by
    lists of paths.
    """
    headers = csv_headers(spark, pattern)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    known = [r["header"] for r in headers.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()]
    if len(known) == 1:
        return _same_header(spark, known[0], pattern, schema)
    tables = []
    for header in known:
        rows = headers.where(F.col("header") == header).select("path").orderBy("path").toLocalIterator()
        while paths := [_escaped(r["path"]) for r in islice(rows, _FILES_A_READ)]:
            tables.append(_same_header(spark, header, paths, schema))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _same_header(spark: SparkSession, header: str, paths: str | list[str], schema: StructType | None) -> DataFrame:
    """Files of one header, with the schema's columns picked by name."""
    if schema is None:
        return read_csv(spark, paths)
    known = {f.name: f for f in schema.fields}
    names = next(csv.reader([header]))
    here = StructType([known.get(n, StructField(n, StringType())) for n in names])
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in names]
    return read_csv(spark, paths, here).select(*[n for n in names if n in known], *missing).select(*known)


def file_stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_text_dir(spark: SparkSession, path: str, key_col: str = "key") -> DataFrame:
    """(key, text), one row per file, keyed by file name (O3)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(file_stem(F.col("_metadata.file_path")).alias(key_col), F.col("value").alias("text"))


def read_image_dir(spark: SparkSession, path: str, key_col: str = "key") -> DataFrame:
    """(key, path) of the image files in a directory."""
    return list_images(spark, path).select(file_stem(F.col("path")).alias(key_col), "path")


def check_separate(inputs: Sequence[str], output: str) -> None:
    """Refuse an output inside an input or the other way round."""
    out = _parts(output)
    for path in inputs:
        given = _parts(path)
        shorter = min(len(out), len(given))
        if out[:shorter] == given[:shorter]:
            raise ValueError(f"output {output!r} and input {path!r} overlap; keep them apart")


def _parts(path: str) -> list[str]:
    url = urlparse(path)
    scheme = "" if url.scheme in ("", "file") else f"{url.scheme}://{url.netloc}"
    where = posixpath.normpath(posixpath.abspath(url.path) if not scheme else url.path)
    return [scheme, *[p for p in where.split("/") if p]]


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _status(spark: SparkSession, path: str):
    where = _hadoop_path(spark, path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)


def _children(spark: SparkSession, path: str) -> list:
    where = _hadoop_path(spark, path)
    return list(where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def resolve_latest(spark: SparkSession, path: str) -> str:
    """Replace the first ``latest`` component by the greatest sub-directory."""
    parts = path.split("/")
    if "latest" not in parts:
        return path
    at = parts.index("latest")
    parent = "/".join(parts[:at]) or "/"
    names = [s.getPath().getName() for s in _children(spark, parent) if s.isDirectory()]
    # Spark's own folders (_temporary and the like) are no runs.
    names = [n for n in names if not n.startswith(("_", "."))]
    if not names:
        raise ValueError(f"no run directory under {parent}")
    return "/".join([*parts[:at], max(names), *parts[at + 1 :]])


def latest_run(df: DataFrame, run_col: str = "run_ts") -> DataFrame:
    """Rows of the newest run; on a table partitioned by ``run_col`` only it is read."""
    return df.where(F.col(run_col) == df.agg(F.max(run_col)).scalar())


def run_history(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest run's rows of the tables that ``record_run`` writes, by name."""
    return {
        name: latest_run(spark.read.parquet(f"{root}/{name}"), "run").drop("run")
        for name in ("runs", "run_steps", "fold_scores")
    }


def read_manifest(
    spark: SparkSession,
    path: str,
    schema: Schema = "file_path string, label array<double>",
) -> DataFrame:
    """Items of a JSON manifest file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_index_splits(spark: SparkSession, path: str) -> DataFrame:
    """(fold, split, row_index) from a JSON list of train / val index lists."""
    document = spark.read.text(path, wholetext=True)
    folds = F.from_json("value", "array<struct<train:array<bigint>,val:array<bigint>>>")
    rows = document.select(F.posexplode(folds).alias("fold", "f"))
    sides = F.array(
        F.struct(F.lit("train").alias("split"), F.col("f.train").alias("ids")),
        F.struct(F.lit("val").alias("split"), F.col("f.val").alias("ids")),
    )
    return rows.select("fold", F.inline(sides)).select(
        "fold", "split", F.explode("ids").alias("row_index")
    )


def rows_of_split(
    df: DataFrame, splits: DataFrame, fold: int, split: str, index_col: str = "row_index"
) -> DataFrame:
    """Rows named by one side of one fold."""
    wanted = splits.where((F.col("fold") == fold) & (F.col("split") == split)).select(
        F.col("row_index").alias("__row")
    )
    return df.join(wanted, F.col(index_col) == F.col("__row"), "left_semi")


def load_inputs(spark: SparkSession, inputs: Sequence[Mapping[str, object]]) -> dict[str, DataFrame]:
    """Inputs by id: ``path`` (csv by default, parquet, jsonl, text_dir, image_dir),
    ``glob`` (csv), or ``from_job`` + ``output`` (newest run of another job) (S1, S2, O1-O5)."""
    tables: dict[str, DataFrame] = {}
    for given in inputs:
        name = str(given["id"])
        if name in tables:
            raise ValueError(f"input id {name!r} is used twice")
        schema = given.get("schema")
        if "glob" in given:
            tables[name] = read_csv_glob(spark, str(given["glob"]), schema)
        elif "from_job" in given:
            runs = resolve_latest(spark, f"{given['from_job']}/latest/{given['output']}")
            tables[name] = read_parquet(spark, runs)
        elif "path" in given:
            path = resolve_latest(spark, str(given["path"]))
            kind = str(given.get("format", "csv"))
            if kind == "csv":
                tables[name] = read_csv(spark, path, schema)
            elif kind == "parquet":
                tables[name] = read_parquet(spark, path)
            elif kind == "jsonl":
                tables[name] = read_jsonl(spark, path, schema)
            elif kind == "text_dir":
                tables[name] = read_text_dir(spark, path)
            elif kind == "image_dir":
                tables[name] = read_image_dir(spark, path)
            else:
                raise ValueError(f"unknown input format {kind!r}")
        else:
            raise ValueError(f"input {name!r} has no path, glob or from_job")
    return tables
