"""A1-A10: profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.catalog.registry import LABELLED, labelled, query, rounded, table
from foldwise.operators.profile import (
    describe, describe_long, distributions, group_counts, group_describe, group_stats, histograms,
    missing_matrix, missing_table, table_profile, value_counts,
)

STATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def _numeric_sql(column: str, source: str, group: str = "") -> str:
    lead = f"{group}, " if group else ""
    return f"""SELECT {lead}'{column}' AS "column", count({column}) AS count, count(*) - count({column}) AS null_count,
        CAST(NULL AS BIGINT) AS uniq, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
        round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
        round(min({column})::DOUBLE, 4) AS min, round(quantile_cont({column}::DOUBLE, 0.25), 4) AS q25,
        round(quantile_cont({column}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({column}::DOUBLE, 0.75), 4) AS q75,
        round(max({column})::DOUBLE, 4) AS max FROM {source} {'GROUP BY ' + group if group else ''}"""


def _text_sql(column: str, source: str, group: str = "") -> str:
    empty = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in STATS)
    by, lead = group or "CAST(0 AS INTEGER)", f"a.g AS {group}, " if group else ""
    return f"""SELECT {lead}'{column}' AS "column", a.count, a.null_count, a.uniq, t.top, t.freq, {empty}
      FROM (SELECT {by} AS g, count({column}) AS count, count(*) - count({column}) AS null_count,
              count(DISTINCT {column}) AS uniq FROM {source} GROUP BY 1) a
      LEFT JOIN (SELECT {by} AS g, CAST({column} AS VARCHAR) AS top, count(*) AS freq,
              row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS k
            FROM {source} WHERE {column} IS NOT NULL GROUP BY {by}, {column}) t
        ON t.g IS NOT DISTINCT FROM a.g AND t.k = 1"""


def _describe_sql(source: str, numeric: list[str], texts: list[str], group: str = "") -> str:
    parts = [_numeric_sql(c, source, group) for c in numeric] + [_text_sql(c, source, group) for c in texts]
    return " UNION ALL ".join(parts)


@query(
    "a1_describe",
    _describe_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority", "o_orderdate"]),
)
def _describe(spark, d):
    return rounded(describe(table(spark, d, "orders")), 4, *STATS)


@query("a1_describe_documents", _describe_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"]))
def _describe_documents(spark, d):
    return rounded(describe(table(spark, d, "documents")), 4, *STATS)


@query(
    "a1_describe_lineitem",
    _describe_sql(
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus", "l_shipdate"],
    ),
)
def _describe_lines(spark, d):
    return rounded(describe(table(spark, d, "lineitem")), 4, *STATS)


def _nearest(column: str, q: float) -> str:
    return f"""(SELECT {column}::DOUBLE FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS r,
      count(*) OVER () AS n FROM part) WHERE r = floor((n - 1) * {q} + 0.5))"""


def _long_sql() -> str:
    columns = ["p_partkey", "p_size", "p_retailprice"]
    statistics = {
        "count": "(SELECT count({0})::DOUBLE FROM part)",
        "null_count": "(SELECT (count(*) - count({0}))::DOUBLE FROM part)",
        "mean": "(SELECT round(avg({0}), 4) FROM part)",
        "std": "(SELECT round(stddev_samp({0}), 4) FROM part)",
        "min": "(SELECT min({0})::DOUBLE FROM part)",
        "25%": 0.25, "50%": 0.5, "75%": 0.75,
        "max": "(SELECT max({0})::DOUBLE FROM part)",
    }
    rows = []
    for name, sql in statistics.items():
        cells = [
            f"{_nearest(c, sql) if isinstance(sql, float) else sql.format(c)} AS {c}" for c in columns
        ]
        rows.append(f"SELECT '{name}' AS statistic, {', '.join(cells)}")
    return " UNION ALL ".join(rows)


@query("a2_describe_long", _long_sql())
def _describe_long(spark, d):
    found = describe_long(table(spark, d, "part"))
    return rounded(found, 4, "p_partkey", "p_size", "p_retailprice")


@query(
    "a3_missing_table",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM {LABELLED}"""
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    ),
)
def _missing(spark, d):
    return rounded(missing_table(labelled(spark, d)), 6, "missing_pct")


@query(
    "a4_table_profile",
    " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, 7 AS n_columns, '{c}' AS "column", {i} AS position, '{t}' AS dtype,
            count(*) - count({c}) AS missing_count FROM {LABELLED}"""
        for i, (c, t) in enumerate(
            {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
             "n_chars": "bigint", "quality": "int", "toxic": "int"}.items()
        )
    ),
)
def _profile(spark, d):
    return table_profile(labelled(spark, d))


def _histogram_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", bin, round(lo + (hi - lo) / 30 * bin, 4) AS bin_left,
        round(lo + (hi - lo) / 30 * (bin + 1), 4) AS bin_right, coalesce(c, 0) AS count
      FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}),
           (SELECT unnest(range(30)) AS bin)
      LEFT JOIN (SELECT least(CAST(floor(({column} - lo) / (hi - lo) * 30) AS BIGINT), 29) AS b, count(*) AS c
                 FROM {source}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source})
                 GROUP BY 1) ON b = bin"""


@query(
    "a5_histogram",
    _histogram_sql("l_quantity", "lineitem") + " UNION ALL " + _histogram_sql("l_extendedprice", "lineitem"),
)
def _histogram(spark, d):
    found = histograms(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(found, 4, "bin_left", "bin_right")


def _top_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS place,
        {column} AS label, CAST(NULL AS DOUBLE) AS bin_left, CAST(NULL AS DOUBLE) AS bin_right, count(*) AS count
      FROM {source} GROUP BY {column} QUALIFY place < 20"""


@query(
    "a5_a6_distributions",
    f"""SELECT "column", bin AS place, CAST(NULL AS VARCHAR) AS label, bin_left, bin_right, count
        FROM ({_histogram_sql('p_size', 'part')} UNION ALL {_histogram_sql('p_retailprice', 'part')}
              UNION ALL {_histogram_sql('p_partkey', 'part')})
        UNION ALL {_top_sql('p_name', 'part')} UNION ALL {_top_sql('p_brand', 'part')} UNION ALL {_top_sql('p_type', 'part')}""",
)
def _distributions(spark, d):
    return rounded(distributions(table(spark, d, "part")), 4, "bin_left", "bin_right")


@query(
    "a5_histogram_infinite",
    """WITH x AS (SELECT l_quantity AS v FROM lineitem WHERE l_orderkey % 50 > 1), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
         h AS (SELECT least(floor((v - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*) AS c FROM x, b GROUP BY 1),
         g AS (SELECT unnest(range(10)) AS bin)
       SELECT 'v' AS "column", bin, round(lo + (hi - lo) / 10 * bin, 4) AS bin_left,
              round(lo + (hi - lo) / 10 * (bin + 1), 4) AS bin_right, coalesce(c, 0) AS count
       FROM b, g LEFT JOIN h USING (bin)
       UNION ALL SELECT 'v', -1, '-inf'::DOUBLE, NULL, count(*) FROM lineitem WHERE l_orderkey % 50 = 0
       UNION ALL SELECT 'v', 10, NULL, 'inf'::DOUBLE, count(*) FROM lineitem WHERE l_orderkey % 50 = 1""",
)
def _histogram_infinite(spark, d):
    key = F.col("l_orderkey") % 50
    value = F.when(key == 0, F.lit(float("-inf"))).when(key == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    found = histograms(table(spark, d, "lineitem").select(value.alias("v")), ["v"], bins=10)
    return rounded(found, 4, "bin_left", "bin_right")


@query(
    "a6_value_counts",
    f"""SELECT quality, count(*) AS count FROM {LABELLED} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20""",
)
def _value_counts(spark, d):
    return value_counts(labelled(spark, d), "quality")


@query(
    "a6_value_counts_top",
    "SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _value_counts_top(spark, d):
    return value_counts(table(spark, d, "part"), "p_name", keep_null=False)


GROUP_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a7_group_stats",
    "SELECT l_returnflag, "
    + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in GROUP_COLUMNS
    )
    + ", count(*) AS count FROM lineitem GROUP BY 1",
)
def _group_stats(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", *GROUP_COLUMNS)
    found = group_stats(lines, "l_returnflag")
    return rounded(found, 6, *[c for c in found.columns if c.endswith(("_mean", "_std"))])


@query(
    "a8_group_describe",
    _describe_sql("events", ["event_id", "user_id", "value"], ["ts", "props"], "event_type"),
)
def _group_describe(spark, d):
    return rounded(group_describe(table(spark, d, "events"), "event_type"), 4, *STATS)


@query(
    "a8_group_describe_many_groups",
    _describe_sql("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], ["l_returnflag"], "l_partkey"),
)
def _many_groups(spark, d):
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return rounded(group_describe(table(spark, d, "lineitem"), "l_partkey", names), 4, *STATS)


@query("a9_group_counts", "SELECT lang, count(*) AS count FROM documents GROUP BY 1")
def _group_counts(spark, d):
    return group_counts(table(spark, d, "documents"), "lang")


def _matrix_sql(bucket: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT bucket, '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 8) AS null_fraction
            FROM (SELECT *, CAST({bucket} AS INTEGER) AS bucket FROM {LABELLED}) GROUP BY 1"""
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    )


@query(
    "a10_missing_matrix",
    _matrix_sql("CAST('0x' || substr(md5(concat_ws('|', '0', doc_id)), 1, 8) AS BIGINT) % 50"),
)
def _matrix(spark, d):
    found = missing_matrix(labelled(spark, d), "doc_id", 50)
    return rounded(found, 8, "null_fraction")


@query(
    "a10_missing_matrix_ordered",
    _matrix_sql("(row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 50.0) AS BIGINT)"),
)
def _matrix_ordered(spark, d):
    found = missing_matrix(labelled(spark, d), "doc_id", 50, order=["doc_id"])
    return rounded(found, 8, "null_fraction")
