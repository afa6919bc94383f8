"""Splits, folds, partitions, run plans and their reports over orders and parts.

Mapping: orders are ids, their customer is the family, and label support comes
from the painted line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import splits as S
from spanforge.operators.ranking import ordered_rank
from spanforge.session import cut_lineage
from workload import interval_queries as IQ
from workload.registry import query, table

SEED = 7


def ids(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))


def families(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group"))


_SQL_SHUFFLED = f"""shuffled AS (SELECT o_orderkey AS id, o_custkey AS grp, row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey),
    o_orderkey) AS rank, count(*) OVER () AS n FROM orders)"""


@query("random_split", "id:i role:s",
       f"""WITH {_SQL_SHUFFLED} SELECT id, CASE WHEN rank <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'train' END
           AS role FROM shuffled""")
def random_split(spark, d):
    return S.split_ids(ids(spark, d), 0.2, SEED)


@query("kfold_split", "id:i fold_index:i",
       f"WITH {_SQL_SHUFFLED} SELECT id, (rank - 1) % 5 + 1 AS fold_index FROM shuffled")
def kfold_split(spark, d):
    return S.kfold(ids(spark, d), 5, SEED)


_SQL_GROUPS = f"""sizes AS (SELECT CAST(o_custkey AS VARCHAR) AS grp, count(*) AS n FROM orders GROUP BY o_custkey),
    g AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, md5('{SEED}:' || grp), grp) AS rn FROM sizes)"""
_SQL_HOLDOUT = f"""WITH RECURSIVE {_SQL_GROUPS},
    goal AS (SELECT CAST(floor(sum(n) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    walk(rn, grp, val, rest, took) AS (
        SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), total, false FROM goal
        UNION ALL
        SELECT rn, grp, val + CASE WHEN take THEN n ELSE 0 END, rest - n, take FROM (
            SELECT g.rn, g.grp, g.n, w.val, w.rest, w.val <> t AND (abs(w.val + g.n - t) < abs(w.val - t)
                OR (w.val < t AND w.val + w.rest - g.n < t)) AS take
            FROM walk w JOIN g ON g.rn = w.rn + 1 CROSS JOIN goal))
    SELECT o_orderkey AS id, walk.grp AS group, CASE WHEN took THEN 'validation' ELSE 'train' END AS role
    FROM orders JOIN walk ON walk.grp = CAST(o_custkey AS VARCHAR)""".replace(" AS group,", ' AS "group",')


@query("grouped_split", "id:i group:s role:s", _SQL_HOLDOUT)
def grouped_split(spark, d):
    return S.split_grouped(ids(spark, d), families(spark, d), 0.2, SEED)


def _sql_bins(n_bins: int, prefix: str, start: str) -> str:
    zeros = "[" + ", ".join(["CAST(0 AS BIGINT)"] * n_bins) + "]"
    return f"""{prefix},
    walk(rn, grp, loads, items, bin) AS (
        SELECT CAST(0 AS BIGINT), {start}, {zeros}, {zeros}, CAST(0 AS BIGINT)
        UNION ALL
        SELECT rn, grp, [CASE WHEN i = pick THEN loads[i] + n ELSE loads[i] END FOR i IN range(1, {n_bins + 1})],
            [CASE WHEN i = pick THEN items[i] + 1 ELSE items[i] END FOR i IN range(1, {n_bins + 1})], pick FROM (
            SELECT g.rn, g.grp, g.n, w.loads, w.items,
                list_min([{{'a': w.loads[i], 'b': w.items[i], 'c': i}} FOR i IN range(1, {n_bins + 1})]).c AS pick
            FROM walk w JOIN g ON g.rn = w.rn + 1))"""


@query("grouped_kfold", "id:i group:s fold_index:i",
       f"""WITH RECURSIVE {_sql_bins(5, _SQL_GROUPS, "''")}
           SELECT o_orderkey AS id, walk.grp AS "group", bin AS fold_index
           FROM orders JOIN walk ON walk.grp = CAST(o_custkey AS VARCHAR)""")
def grouped_kfold(spark, d):
    return S.kfold_grouped(ids(spark, d), families(spark, d), 5, SEED)


_SQL_PARTS = """g AS (SELECT p_partkey AS grp, CASE WHEN p_size % 6 = 0 THEN 1 ELSE p_size END AS n,
    row_number() OVER (ORDER BY CASE WHEN p_size % 6 = 0 THEN 1 ELSE p_size END DESC, p_brand, p_partkey) AS rn FROM part)"""


@query("weighted_partitions", "id:i weight:i part:i",
       f"""WITH RECURSIVE {_sql_bins(7, _SQL_PARTS, "CAST(0 AS BIGINT)")}
           SELECT grp AS id, n AS weight, bin - 1 AS part FROM walk JOIN g USING (rn, grp) WHERE rn > 0""")
def weighted_partitions(spark, d):
    bad = F.when(F.col("p_size") % 12 == 0, float("nan")).otherwise(-1.0)
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 6 == 0, bad).otherwise(F.col("p_size")).alias("weight"), "p_brand"
    )
    return S.partition_weighted(rows, 7, group="p_brand", require_all=True)


def support(spark, d):
    return IQ.I.label_support(ids(spark, d), IQ.segments(spark, d))


@query("stratified_split", "id:i group:s role:s")
def stratified_split(spark, d):
    return S.split_stratified(ids(spark, d), families(spark, d), support(spark, d), 0.2)


@query("stratified_kfold", "id:i group:s fold_index:i")
def stratified_kfold(spark, d):
    return S.kfold_stratified(ids(spark, d), families(spark, d), support(spark, d), 5)


_INVARIANTS = """SELECT count(*) AS n_ids, count(DISTINCT o_custkey) AS n_groups, 0 AS n_straddling, {sides} AS n_sides
                 FROM orders"""


@query("stratified_split_invariants", "n_ids:i n_groups:i n_straddling:i n_sides:i", _INVARIANTS.format(sides=2))
def stratified_split_invariants(spark, d):
    return _invariants(stratified_split(spark, d), "role")


@query("stratified_kfold_invariants", "n_ids:i n_groups:i n_straddling:i n_sides:i", _INVARIANTS.format(sides=5))
def stratified_kfold_invariants(spark, d):
    return _invariants(stratified_kfold(spark, d), "fold_index")


def _invariants(assigned, side):
    per_group = assigned.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(side).alias("a"), F.max(side).alias("b"))
    return per_group.agg(
        F.sum("n").alias("n_ids"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("a") != F.col("b")).alias("n_straddling"),
        F.count_distinct("a").alias("n_sides"),
    )


def seeded_plan(spark, d):
    return S.fold_plan(ids(spark, d), None, n_folds=3, split_seeds=[SEED, 8], train_seeds=[1, 2])


_SQL_PLAN = """folds AS (SELECT seed, sidx, tseed, o_orderkey AS id, (row_number() OVER (PARTITION BY seed
        ORDER BY md5(seed || ':' || o_orderkey), o_orderkey) - 1) % 3 + 1 AS own
        FROM orders CROSS JOIN (VALUES (7, 1, 1), (8, 2, 2)) AS s(seed, sidx, tseed)),
    plan AS (SELECT (sidx - 1) * 3 + fold AS run_index, sidx AS set_index, fold AS fold_index, seed AS split_seed,
        tseed AS train_seed, id, CASE WHEN own = fold THEN 'validation' ELSE 'train' END AS role
        FROM folds CROSS JOIN range(1, 4) AS r(fold))"""


@query("run_plan", "run_index:i set_index:i fold_index:i split_seed:i train_seed:i id:i role:s",
       f"WITH {_SQL_PLAN} SELECT * FROM plan")
def run_plan(spark, d):
    return seeded_plan(spark, d).runs()


@query("leaked_families", "run_index:i group:s",
       f"""WITH {_SQL_PLAN} SELECT run_index, CAST(o_custkey AS VARCHAR) AS "group" FROM plan JOIN orders ON id = o_orderkey
           GROUP BY run_index, o_custkey HAVING count(DISTINCT role) = 2""")
def leaked_families(spark, d):
    return S.leaked_groups(seeded_plan(spark, d), families(spark, d))


@query("split_report",
       "run_index:i role:s protein_count:i valid_residues:i positive_residues:i negative_residues:i positive_rate:d",
       f"""WITH {_SQL_PLAN}, {IQ.SQL_POS}, per AS (SELECT id, count(*) FILTER (WHERE label <> 'uncertain') AS v,
             count(*) FILTER (WHERE label = 'def') AS p, count(*) FILTER (WHERE label = 'not') AS n FROM positions GROUP BY id),
           rows_ AS (SELECT run_index, role, id FROM plan UNION ALL SELECT NULL, 'all', o_orderkey FROM orders)
           SELECT run_index, role, count(*) AS protein_count, sum(v) AS valid_residues, sum(p) AS positive_residues,
             sum(n) AS negative_residues, sum(p) / CAST(sum(v) AS DOUBLE) AS positive_rate
           FROM rows_ JOIN per USING (id) GROUP BY run_index, role""")
def split_report(spark, d):
    return S.split_report(seeded_plan(spark, d), support(spark, d))


@query("split_family_counts", "run_index:i role:s family:s n_ids:i",
       f"""WITH {_SQL_PLAN} SELECT run_index, role, o_orderpriority AS family, count(*) AS n_ids
           FROM plan JOIN orders ON id = o_orderkey GROUP BY ALL""")
def split_family_counts(spark, d):
    return S.family_counts(seeded_plan(spark, d), _priorities(spark, d), family="family")


@query("split_family_maps", "run_index:i role:s families:s",
       f"""WITH {_SQL_PLAN}, c AS (SELECT run_index, role, o_orderpriority AS f, count(*) AS n
             FROM plan JOIN orders ON id = o_orderkey GROUP BY ALL)
           SELECT run_index, role, string_agg(f || '=' || n, ',' ORDER BY f) AS families FROM c GROUP BY run_index, role""")
def split_family_maps(spark, d):
    maps = S.as_maps(S.family_counts(seeded_plan(spark, d), _priorities(spark, d), family="family"), "family", "families")
    pairs = F.transform(F.map_entries("families"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.withColumn("families", F.array_join(pairs, ","))


def _priorities(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"))


@query("split_shard_counts", "run_index:i role:s label_shard:s n_ids:i",
       f"""WITH {_SQL_PLAN} SELECT run_index, role, CASE WHEN id % 5 = 3 THEN '__missing_label__' ELSE 'shard_' || (id % 8) END
             AS label_shard, count(*) AS n_ids FROM plan GROUP BY ALL""")
def split_shard_counts(spark, d):
    shards = ids(spark, d).withColumn("label_shard", F.when(F.col("id") % 5 != 3, F.concat(F.lit("shard_"), F.col("id") % 8)))
    return S.shard_counts(seeded_plan(spark, d), shards)


@query("missing_family_groups", "id:i group:s",
       """SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN '__missing_family__:' || o_orderkey
            ELSE CAST(o_custkey AS VARCHAR) END AS "group" FROM orders""")
def missing_family_groups(spark, d):
    known = families(spark, d).filter(F.col("group") % 3 != 0).withColumnRenamed("group", "family")
    return S.missing_family_groups(ids(spark, d), known)


def _placed(rows):
    """0-based place of each row in the order that the rows stand in."""
    numbered = cut_lineage(rows.withColumn("number", F.monotonically_increasing_id()))
    return ordered_rank(numbered, [F.col("number")], out="place").withColumn("place", F.col("place") - 1)


@query("group_block_order", "id:i block_digest:s place:i",
       f"""SELECT o_orderkey AS id, md5('{SEED}:' || o_custkey) AS block_digest,
             row_number() OVER (ORDER BY md5('{SEED}:' || o_custkey), o_custkey, o_orderkey) - 1 AS place FROM orders""")
def group_block_order(spark, d):
    return _placed(S.group_block_order(families(spark, d), SEED))


@query("locality_order", "id:i group:s place:i",
       """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS "group",
            row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), o_orderkey) - 1 AS place FROM orders""")
def locality_order(spark, d):
    return _placed(S.locality_order(families(spark, d)))
