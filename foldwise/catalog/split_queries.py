"""F: cross-validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.catalog.registry import kfold_sql, query, shuffle_sql, table
from foldwise.operators.sample import stratified_subsample
from foldwise.operators.split import (
    assign_folds, group_kfold, kfold, leave_one_group_out, stratified_group_kfold,
    stratified_kfold, time_series,
)


@query("f0_no_split", "SELECT o_orderkey, o_orderstatus FROM orders")
def _none(spark, d):
    return assign_folds(table(spark, d, "orders"), "none").select("o_orderkey", "o_orderstatus")


@query("f1_kfold", f"SELECT o_orderkey, {kfold_sql('o_orderkey')} AS fold FROM orders")
def _kfold(spark, d):
    return kfold(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query(
    "f1_kfold_hash",
    f"""SELECT o_orderkey, CAST(CAST('0x' || substr({shuffle_sql('o_orderkey')}, 1, 8) AS BIGINT) % 5 AS INTEGER)
        AS fold FROM orders""",
)
def _kfold_hash(spark, d):
    return kfold(table(spark, d, "orders"), "o_orderkey", exact=False).select("o_orderkey", "fold")


TIME_BLOCKS = """b AS (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events),
t AS (SELECT *, n - 5 * (n // 6) AS first FROM b)"""


@query(
    "f2_time_series",
    f"""WITH {TIME_BLOCKS} SELECT event_id,
          CAST(CASE WHEN r < first THEN 0 ELSE (r - first) // (n // 6) + 1 END AS INTEGER) AS block FROM t""",
)
def _time(spark, d):
    return time_series(table(spark, d, "events"), "ts", "event_id").select("event_id", "block")


STRATIFIED = f"""c AS (SELECT o_orderstatus, count(*) % 5 AS r FROM orders GROUP BY 1),
s AS (SELECT o_orderstatus,
        coalesce(sum(r) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
      FROM c),
t AS (SELECT o_orderkey, o_orderstatus,
        ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY {shuffle_sql('o_orderkey')}) - 1 AS run FROM orders)"""


@query(
    "f3_stratified_kfold",
    f"""WITH {STRATIFIED} SELECT o_orderkey, CAST((turn + run) % 5 AS INTEGER) AS fold
        FROM t JOIN s USING (o_orderstatus)""",
)
def _stratified(spark, d):
    folds = stratified_kfold(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")
    return folds.select("o_orderkey", "fold")


SNAKE = "CAST(CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS INTEGER)"


@query(
    "f4_group_kfold",
    f"""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS p
                   FROM events GROUP BY user_id)
        SELECT event_id, user_id, {SNAKE} AS fold FROM events JOIN g USING (user_id)""",
)
def _group(spark, d):
    folds = group_kfold(table(spark, d, "events"), "user_id")
    return folds.select("event_id", "user_id", "fold")


def _dealt_sql(level: int, source: str) -> str:
    """Deal the items of ``source`` (item, pos, v) to folds, in chunks of 4,096 items.

    The folds of a chunk's first item are its positions.  Then, for a class, the fold with the
    least of it gets the item's part with the most; of the classes but the commonest, the one
    whose deal leaves all classes most even is followed.
    """
    return f"""q{level} AS MATERIALIZED (SELECT item, item // 4096 AS chunk, pos, v, c, row_number() OVER (PARTITION BY item, c ORDER BY v[c] DESC, pos) AS r
          FROM {source}, tried),
        d{level} AS (
          SELECT item, item // 4096 AS chunk, pos, pos AS fold, v AS load FROM {source} WHERE item % 4096 = 0
          UNION ALL
          SELECT item, chunk, pos, fold, load FROM (
            WITH s AS (SELECT d.*, c, row_number() OVER (PARTITION BY item, c ORDER BY load[c], fold) AS r FROM d{level} d, tried),
            t AS (SELECT q.item, q.chunk, q.pos, s.fold, s.c, list_transform(list_zip(s.load, q.v), lambda x: x[1] + x[2]) AS load
                  FROM s JOIN q{level} q ON q.item = s.item + 1 AND q.chunk = s.chunk AND q.c = s.c AND q.r = s.r),
            e AS (SELECT item, c, (max(load[j]) - min(load[j])) * (1e0 / greatest(sum(load[j]), 1)) AS uneven FROM t, classes GROUP BY item, c, j),
            b AS (SELECT item, c FROM e GROUP BY item, c QUALIFY row_number() OVER (PARTITION BY item ORDER BY max(uneven), c) = 1)
            SELECT t.* FROM t JOIN b USING (item, c))),
        m{level} AS (SELECT chunk AS item, fold AS pos, load AS v FROM d{level} QUALIFY item = max(item) OVER (PARTITION BY chunk))"""


STRATIFIED_GROUPS = f"""c AS (SELECT event_type, least(row_number() OVER (ORDER BY count(*) DESC, event_type NULLS FIRST), 33) AS j FROM events GROUP BY 1),
        k AS (SELECT CASE WHEN count(*) < 32 THEN count(*) ELSE 33 END AS k FROM c),
        classes AS (SELECT unnest(range(1, k + 1)) AS j FROM k),
        tried AS (SELECT unnest(CASE WHEN k = 1 THEN [1::BIGINT] ELSE range(2, k + 1) END) AS c FROM k),
        n AS (SELECT user_id, j, count(*) AS n FROM events e JOIN c ON e.event_type IS NOT DISTINCT FROM c.event_type GROUP BY ALL),
        u AS (SELECT u.user_id, sum(coalesce(n, 0))::BIGINT AS size, list(coalesce(n, 0) ORDER BY classes.j) AS v
              FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN classes
              LEFT JOIN n ON n.user_id IS NOT DISTINCT FROM u.user_id AND n.j = classes.j GROUP BY 1),
        z AS (SELECT *, row_number() OVER w - 1 AS p, sum(size) OVER () - sum(size) OVER w + size AS rest FROM u
              WINDOW w AS (ORDER BY size DESC, user_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT least(4, coalesce(min(p) FILTER (WHERE size * (5 - p) < rest), 4)) AS alone FROM z),
        o AS (SELECT user_id, v, 5 - alone AS folds, row_number() OVER (ORDER BY v[1] DESC, size DESC, user_id NULLS FIRST) - 1 AS p
              FROM z, a WHERE p >= alone),
        i AS (SELECT user_id, p // folds AS item, p % folds AS pos, v FROM o UNION ALL
              SELECT NULL, last // folds, unnest(range(last % folds + 1, folds)), list_transform(range(k), lambda x: 0::BIGINT)
              FROM (SELECT max(p) AS last, max(folds) AS folds FROM o), k),
        {_dealt_sql(0, "i")},
        {_dealt_sql(1, "m0")},
        {_dealt_sql(2, "m1")},
        g AS (SELECT o.user_id, alone + d2.fold AS fold FROM a, o JOIN d0 ON d0.item = o.p // o.folds AND d0.pos = o.p % o.folds
                JOIN d1 ON d1.item = d0.chunk AND d1.pos = d0.fold JOIN d2 ON d2.item = d1.chunk AND d2.pos = d1.fold
              UNION ALL SELECT user_id, p FROM z, a WHERE p < alone)"""


@query(
    "f5_stratified_group_kfold",
    f"""WITH RECURSIVE {STRATIFIED_GROUPS}
        SELECT event_id, e.user_id, CAST(fold AS INTEGER) AS fold FROM events e JOIN g ON e.user_id IS NOT DISTINCT FROM g.user_id""",
)
def _stratified_group(spark, d):
    folds = stratified_group_kfold(table(spark, d, "events"), "event_type", "user_id")
    return folds.select("event_id", "user_id", "fold")


@query(
    "f6_leave_one_group_out",
    "SELECT event_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS fold FROM events",
)
def _logo(spark, d):
    return leave_one_group_out(table(spark, d, "events"), "user_id").select("event_id", "fold")


@query(
    "f7_split_after_subsample",
    f"""WITH s AS (
          SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {shuffle_sql('o_orderkey', 7)}) AS r,
                 greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.3)) AS keep FROM orders),
        kept AS (SELECT o_orderkey FROM s WHERE r <= keep)
        SELECT o_orderkey, {kfold_sql('o_orderkey', 3)} AS fold FROM kept""",
)
def _resplit(spark, d):
    kept = stratified_subsample(table(spark, d, "orders"), 0.3, "o_orderstatus", "o_orderkey", seed=7)
    return kfold(kept, "o_orderkey", 3).select("o_orderkey", "fold")


@query(
    "f1_fold_sizes",
    f"""SELECT fold, count(*) AS n FROM (SELECT {kfold_sql('event_id', 7)} AS fold FROM events) GROUP BY 1""",
)
def _sizes(spark, d):
    folds = kfold(table(spark, d, "events"), "event_id", 7)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
