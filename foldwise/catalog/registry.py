"""Registration of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums depend on the order of the rows in the last bits: compare fewer digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, NULL where there is none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents only, with a score in (0, 1) from their length."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", "lang", "quality", "toxic",
        (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"),
    )


JUDGED = """judged AS (
  SELECT doc_id, lang, quality, toxic, n_chars / (n_chars + 1000) AS score
  FROM documents JOIN labels USING (doc_id))"""


def finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and a 0/1 target."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    from foldwise.operators.joins import join_tables

    joined = join_tables([orders, customer], on="o_custkey")
    return joined.withColumn("finished", (F.col("o_orderstatus") == "F").cast("int"))


FINISHED = """finished_orders AS (
  SELECT o.*, c.* EXCLUDE (c_custkey), CAST(o_orderstatus = 'F' AS INTEGER) AS finished
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


def shuffle_sql(key: str, seed: int = 42) -> str:
    """SQL of the seeded shuffle order of one non-null key."""
    return f"md5(concat_ws('|', '{seed}', {key}))"


def kfold_sql(key: str, k: int = 5) -> str:
    return f"CAST(ntile({k}) OVER (ORDER BY {shuffle_sql(key)}) - 1 AS INTEGER)"
