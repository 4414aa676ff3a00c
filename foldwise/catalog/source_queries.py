"""S and O: sources and sinks, as round trips of the test tables through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.catalog.registry import (
    JUDGED, LABELLED, judged, kfold_sql, labelled, query, rounded, table,
)
from foldwise.operators.evaluate import binary_auc
from foldwise.operators.media import list_images
from foldwise.operators.profile import missing_table, table_profile
from foldwise.operators.split import kfold
from foldwise.plans.recipe import compose
from foldwise.session import scratch_path
from foldwise.sources.readers import (
    csv_files, latest_run, load_inputs, read_csv, read_csv_directory, read_csv_glob, read_index_splits,
    read_manifest, read_parquet, run_history,
)
from foldwise.sources.writers import (
    read_fold, record_run, write_folds, write_predictions, write_statistics, write_table,
)


def _as_csv(df, path):
    df.write.option("header", True).csv(path)
    return path


@query("s1_csv_source", "SELECT * FROM customer")
def _csv(spark, d):
    customer = table(spark, d, "customer")
    path = _as_csv(customer, scratch_path(spark, "customer"))
    return read_csv(spark, path, customer.schema)


@query(
    "s2_parquet_source",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000",
)
def _parquet(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet")
    return orders.where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query(
    "s3_csv_directory",
    "SELECT s_suppkey, s_name, s_acctbal, s_suppkey % 4 AS remainder, true AS from_file FROM supplier",
)
def _directory(spark, d):
    """Files of suppliers by remainder, read together and told apart by their paths."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    # A range partitioning would cut by a sample and may put two remainders into one file.
    parted = supplier.withColumn("part", F.col("s_suppkey") % 4).repartition("part")
    path = scratch_path(spark, "supplier")
    parted.write.partitionBy("part").option("header", True).csv(path)
    rows = read_csv_directory(spark, path, supplier.schema)
    return rows.select(
        *supplier.columns, F.regexp_extract("source_file", "/part=([0-9]+)/", 1).cast("long").alias("remainder"),
        F.col("source_file").endswith(".csv").alias("from_file"),
    )


@query(
    "s3_csv_files",
    """SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1""",
)
def _files(spark, d):
    """A folder of files per nation; the files inside each are found and read."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    path = scratch_path(spark, "supplier")
    supplier.write.partitionBy("s_nationkey").option("header", True).csv(path)
    nations = sorted(r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect())
    status = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = {s.getPath().getName() for s in status.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status)}
    folders = [f"{path}/s_nationkey={k}" for k in nations if f"s_nationkey={k}" in held]
    rows = read_csv(spark, csv_files(spark, folders), "s_suppkey bigint, s_acctbal double")
    nation = F.regexp_extract(F.col("_metadata.file_path"), "s_nationkey=([0-9]+)", 1).cast("int")
    return rows.groupBy(nation.alias("s_nationkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance")
    )


@query(
    "s3_profile_by_file",
    """SELECT o_orderstatus AS source, 'o_custkey' AS "column", count(*) AS n_rows, 0 AS missing_count FROM orders GROUP BY 1
       UNION ALL SELECT o_orderstatus, 'o_orderpriority', count(*), 0 FROM orders GROUP BY 1""",
)
def _by_file(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    path = scratch_path(spark, "orders")
    orders.write.partitionBy("o_orderstatus").option("header", True).csv(path)
    schema = "o_custkey bigint, o_orderpriority string, o_orderstatus string"
    rows = read_csv_directory(spark, path, schema)
    found = table_profile(rows.drop("o_orderstatus"), ["source_file"])
    # Every file holds one status: profiles by file add up to those by status.
    status = F.regexp_extract("source_file", "o_orderstatus=([A-Z])", 1).alias("source")
    return found.groupBy(status, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("missing_count").cast("int").alias("missing_count")
    )


@query("s5_parquet_sink", "SELECT p_partkey, p_brand FROM part")
def _sink(spark, d):
    path = write_table(table(spark, d, "part"), scratch_path(spark, "out"), "parts", ["p_partkey", "p_brand"])
    return spark.read.parquet(path)


FOLDED = f"t AS (SELECT o_orderkey, o_orderstatus, {kfold_sql('o_orderkey', 3)} AS fold FROM orders)"


@query(
    "s6_fold_sink",
    f"WITH {FOLDED} SELECT o_orderstatus, count(*) AS n FROM t WHERE fold <> 1 GROUP BY 1",
)
def _folds(spark, d):
    folds = kfold(table(spark, d, "orders"), "o_orderkey", 3)
    path = write_folds(folds, scratch_path(spark, "out"), "train_out", ["o_orderkey", "o_orderstatus"])
    return read_fold(spark, path, 1, "train").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_fold_sink_exploded",
    f"""WITH {FOLDED}, k AS (SELECT unnest(range(3)) AS i)
        SELECT CAST(i AS INTEGER) AS fold, CASE WHEN i = fold THEN 'test' ELSE 'train' END AS split, count(*) AS n
        FROM t, k GROUP BY ALL""",
)
def _exploded(spark, d):
    folds = kfold(table(spark, d, "orders"), "o_orderkey", 3)
    path = write_folds(
        folds, scratch_path(spark, "out"), "train_out", ["o_orderkey"], layout="exploded", n_splits=3
    )
    return spark.read.parquet(path).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_prediction_sink",
    f"WITH {JUDGED} SELECT doc_id, CAST(score >= 0.6 AS INTEGER) AS quality, round(score, 8) AS proba FROM judged",
)
def _predictions(spark, d):
    rows = judged(spark, d).select("doc_id", F.col("score").alias("prediction"))
    paths = write_predictions(rows, scratch_path(spark, "out"), "doc_id", "quality", 0.6)
    labels = read_csv(spark, paths["submission"], "doc_id bigint, quality int")
    proba = read_csv(spark, paths["submission_proba"], "doc_id bigint, proba double")
    return rounded(labels.join(proba, "doc_id"), 8, "proba")


@query(
    "s8_statistics_sink",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count FROM {LABELLED}"""
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    ),
)
def _statistics(spark, d):
    path = write_statistics(missing_table(labelled(spark, d)), scratch_path(spark, "missing"), "csv")
    found = read_csv(spark, path, "column string, missing_count bigint, missing_pct double")
    return found.drop("missing_pct")


@query(
    "s9_latest_run",
    """WITH e AS (SELECT event_id, strftime(ts, '%Y%m') AS run_ts FROM events)
       SELECT event_id, run_ts FROM e WHERE run_ts = (SELECT max(run_ts) FROM e)""",
)
def _latest(spark, d):
    path = scratch_path(spark, "runs")
    events = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMM").alias("run_ts"))
    events.write.partitionBy("run_ts").parquet(path)
    schema = "event_id bigint, run_ts string"
    return latest_run(spark.read.schema(schema).parquet(path)).select("event_id", "run_ts")


@query(
    "s10_run_tables",
    f"""WITH {JUDGED}, f AS (SELECT {kfold_sql('doc_id')} AS fold, quality AS y, score AS p FROM judged),
        r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM f)
        SELECT 'r1' AS run_ts, fold, CAST(NULL AS DOUBLE) AS train_score,
               round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
                     / nullif(sum(y) * (count(*) - sum(y)), 0), 8) AS valid_score FROM r GROUP BY fold""",
)
def _runs(spark, d):
    areas = binary_auc(kfold(judged(spark, d), "doc_id"), "quality", "score", ["fold"], "valid_score")
    scores = areas.withColumn("train_score", F.lit(None).cast("double"))
    root = scratch_path(spark, "runs")
    record_run(spark, root, {"run_ts": "r1", "job_id": "auc", "kind": "train", "seed": 42}, fold_scores=scores)
    return rounded(spark.read.parquet(f"{root}/fold_scores").drop("run"), 8, "valid_score")


STEPS = [
    {"id": "long", "method": "arithmetic", "options": {"operation": "multiply", "col_a": "score", "col_b": "score", "output_col": "squared"}},
    {"id": "gone", "method": "no_such_step"},
    {"id": "torn", "method": "select_columns", "options": {"columns": ["no_such_column"]}},
    {"id": "folds", "method": "assign_folds", "options": {"strategy": "kfold", "keys": "doc_id"}},
]


@query(
    "s10_run_history",
    f"""WITH {JUDGED}, f AS (SELECT {kfold_sql('doc_id')} AS fold, quality AS y, score AS p FROM judged),
        r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM f),
        a AS (SELECT fold, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
                     / nullif(sum(y) * (count(*) - sum(y)), 0), 8) AS valid_score FROM r GROUP BY fold),
        s AS (SELECT * FROM (VALUES ('long', 'arithmetic', 'ok'), ('gone', 'no_such_step', 'skipped'),
                ('torn', 'select_columns', 'failed'), ('folds', 'assign_folds', 'ok')) AS v(step_id, method, status))
        SELECT 'r2' AS run_ts, 'train' AS kind, 42::BIGINT AS seed, step_id, method, status,
          status <> 'ok' AS has_reason, fold, valid_score FROM s, a""",
)
def _history(spark, d):
    """Two runs of a recipe with a skipped and a failed step; all that is known of the newer one."""
    root = scratch_path(spark, "runs")
    for run, seed in (("r1", 7), ("r2", 42)):
        made = compose({"judged": judged(spark, d)}, STEPS, on_error="record")
        areas = binary_auc(made.tables["folds"], "quality", "score", ["fold"], "valid_score")
        scores = areas.withColumn("train_score", F.lit(None).cast("double"))
        record_run(spark, root, {"run_ts": run, "job_id": "auc", "kind": "train", "seed": seed}, made.steps, scores)
    tables = run_history(spark, root)
    joined = tables["runs"].join(tables["run_steps"], "run_ts").join(tables["fold_scores"], "run_ts")
    found = joined.withColumn("has_reason", F.col("reason").isNotNull())
    return rounded(
        found.select("run_ts", "kind", "seed", "step_id", "method", "status", "has_reason", "fold", "valid_score"),
        8, "valid_score",
    )


def _one_file_each(rows, key, value, suffix):
    """Write ``value`` of every row as ``<key><suffix>`` in a new folder.

    Spark writes a folder per key; only the files' names are changed on the driver.
    """
    spark = rows.sparkSession
    made, path = scratch_path(spark, "parts"), scratch_path(spark, "files")
    rows.select(F.col(key).cast("string").alias("key"), value.alias("value")).write.partitionBy("key").text(made)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for folder in fs.listStatus(at(made)):
        name = folder.getPath().getName()
        if name.startswith("key="):
            part = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(part[0], at(f"{path}/{name.removeprefix('key=')}{suffix}"))
    return path


@query(
    "o3_text_dir",
    """SELECT 'n' || n_nationkey AS key, n_name || chr(10) || n_regionkey || chr(10) AS text FROM nation""",
)
def _text_dir(spark, d):
    nation = table(spark, d, "nation").withColumn("file", F.concat(F.lit("n"), F.col("n_nationkey")))
    text = F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string"))
    path = _one_file_each(nation, "file", text, ".txt")
    return load_inputs(spark, [{"id": "texts", "path": path, "format": "text_dir"}])["texts"].select("key", "text")


@query("o4_image_dir", "SELECT 'n' || n_nationkey AS key, 'n' || n_nationkey || '.png' AS file FROM nation")
def _image_dir(spark, d):
    nation = table(spark, d, "nation").withColumn("file", F.concat(F.lit("n"), F.col("n_nationkey")))
    path = _one_file_each(nation, "file", F.col("n_name"), ".png")
    found = load_inputs(spark, [{"id": "images", "path": path, "format": "image_dir"}])["images"]
    return found.select("key", F.element_at(F.split("path", "/"), -1).alias("file"))


@query(
    "s12_image_listing",
    """SELECT name, n_nationkey % 3 <> 2 AS listed FROM (SELECT n_nationkey,
         'n' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' ELSE '.txt' END AS name FROM nation)""",
)
def _image_listing(spark, d):
    """Of files with all kinds of suffixes, which are listed as images."""
    kind = F.when(F.col("n_nationkey") % 3 == 0, ".png").when(F.col("n_nationkey") % 3 == 1, ".jpeg").otherwise(".txt")
    nation = table(spark, d, "nation").withColumn("name", F.concat(F.lit("n"), F.col("n_nationkey"), kind))
    path = _one_file_each(nation, "name", F.col("n_name"), "")
    listed = list_images(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(True).alias("listed"))
    return nation.select("name").join(listed, "name", "left").fillna(False, ["listed"])


@query("o1_csv_glob", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _glob(spark, d):
    nation = table(spark, d, "nation")
    path = _as_csv(nation, scratch_path(spark, "nation"))
    return read_csv_glob(spark, f"{path}/*.csv", nation.schema)


@query(
    "o1_csv_glob_headers",
    """SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2 UNION ALL
       SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_regionkey >= 2""",
)
def _glob_headers(spark, d):
    nation = table(spark, d, "nation")
    path = scratch_path(spark, "nations")
    _as_csv(nation.where("n_regionkey < 2").select("n_regionkey", "n_name", "n_nationkey"), f"{path}/a")
    _as_csv(nation.where("n_regionkey >= 2").selectExpr("n_nationkey", "n_regionkey", "1 AS more"), f"{path}/b")
    return read_csv_glob(spark, f"{path}/*/*.csv", nation.schema)


@query("o2_jsonl_input", "SELECT doc_id, quality, toxic FROM labels")
def _jsonl(spark, d):
    labels = table(spark, d, "labels")
    path = scratch_path(spark, "labels")
    labels.write.json(path)
    given = [{"id": "labels", "path": path, "format": "jsonl", "schema": labels.schema}]
    return load_inputs(spark, given)["labels"]


# JSON documents hold this many items each, however large the table.
ITEMS = 1000


def _documents(rows, item, path):
    """Write ``item`` of consecutive ids as JSON documents of bounded size, one per file."""
    bucket = F.floor(F.col("doc_id") / ITEMS)
    documents = rows.groupBy(bucket).agg(item.alias("value")).select("value")
    documents.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "s11_manifest",
    """SELECT 'docs/' || doc_id AS file_path, CAST(quality AS DOUBLE) AS first, CAST(toxic AS DOUBLE) AS second
       FROM labels""",
)
def _manifest(spark, d):
    file_path = F.concat(F.lit("docs/"), F.col("doc_id"))
    label = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    items = F.to_json(F.collect_list(F.struct(file_path.alias("file_path"), label.alias("label"))))
    path = _documents(table(spark, d, "labels"), items, scratch_path(spark, "manifest"))
    rows = read_manifest(spark, path)
    return rows.select("file_path", F.col("label")[0].alias("first"), F.col("label")[1].alias("second"))


@query(
    "s11_index_splits",
    """SELECT CAST(i AS INTEGER) AS fold, CASE WHEN doc_id % 3 = i THEN 'val' ELSE 'train' END AS split,
              doc_id AS row_index FROM documents, (SELECT unnest(range(3)) AS i)""",
)
def _index_splits(spark, d):
    documents = table(spark, d, "documents")

    def fold(i):
        own = F.col("doc_id") % 3 == i
        sides = {"train": ~own, "val": own}
        return F.struct(*[F.collect_list(F.when(c, F.col("doc_id"))).alias(n) for n, c in sides.items()])

    folds = F.to_json(F.array(*[fold(i) for i in range(3)]))
    return read_index_splits(spark, _documents(documents, folds, scratch_path(spark, "splits")))


@query(
    "o5_from_job",
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0",
)
def _from_job(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    job = scratch_path(spark, "job")
    supplier.write.parquet(f"{job}/20260101T000000/out")
    supplier.where("s_acctbal > 0").write.parquet(f"{job}/20260102T000000/out")
    return load_inputs(spark, [{"id": "in", "from_job": job, "output": "out"}])["in"]


@query(
    "o6_o7_recipe_steps",
    """SELECT p_partkey, 'img/' || p_partkey || '.png' AS path FROM part""",
)
def _steps(spark, d):
    made = compose(
        {"part": table(spark, d, "part")},
        [
            {"id": "short", "method": "select_columns", "options": {"columns": ["p_partkey", "p_name"]}},
            {"id": "kept", "method": "checkpoint"},
            {"id": "path", "method": "format_column",
             "options": {"template": "img/{p_partkey}.png", "source_col": "p_partkey", "output_col": "path"}},
            {"id": "out", "method": "drop_source", "options": {"columns": ["p_name"]}},
        ],
    )
    return made.tables["out"]
