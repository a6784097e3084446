"""Incremental loads, merges, key-value items and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cleaning, incremental, kv
from quern.plans import inputs
from quern.plans.inputs import FACTS, GRID, table


def offers(spark, d):
    """Orders with their year as wave."""
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("wave"), "o_totalprice", "o_orderstatus")


_OFFERS = "offers AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS wave, o_totalprice, o_orderstatus FROM orders)"


def watermark_next(spark, d):
    """Each run's rows and watermark as the loads go on, the last one empty."""
    rows, last = [], None
    for run, (upto, full) in enumerate(((1996, False), (1998, False), (2001, False), (2001, False)), 1):
        got = incremental.extract(offers(spark, d).where(F.col("wave") <= upto), "wave", last, full)
        new = incremental.guarded_watermark(got, "wave", last)
        rows.append((run, got.count(), last, new))
        last = new
    return spark.createDataFrame(rows, "run int, extracted bigint, watermark_before string, watermark_after string")


def merge_upsert(spark, d):
    base = offers(spark, d)
    target = base.where("wave <= 1997").withColumn("o_orderstatus", F.lit("?"))
    return incremental.merge(target, base.where("wave >= 1997"), ["o_orderkey"])


def replace_by_run(spark, d):
    base = offers(spark, d).select(F.concat(F.lit("through-wave-"), F.col("wave")).alias("run_id"), "o_orderkey", "o_totalprice")
    again = base.where("run_id = 'through-wave-1998'").where(F.col("o_orderkey") % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return incremental.replace_run(base, again, "through-wave-1998")


def star_stage_fact(spark, d):
    """The fact window from the newest loaded wave on, with arms; unmatched customers and arms are counted, not dropped."""
    spine = inputs.facts(spark, d)
    staged = incremental.newest_window(spine, spine.where("wave <= 2").select("wave"), "wave")
    return staged.select("offer_id", "wave", "arm_id", (F.col("took_up") == 1).alias("took_up"))


def fact_parity(spark, d):
    """One row: spine rows, rows with a customer, and rows without an arm."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    counted = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return counted(orders, "spine").join(counted(joined, "matched")).join(inputs.facts(spark, d).agg(F.count_if(F.col("arm_id").isNull()).alias("without_arm")))


def kv_items(spark, d):
    made = inputs.GRID.frame(spark).withColumns({"run": F.lit("r1"), "version": F.lit(3)})
    items = kv.items(made, "r1#arms", ["risk_band", "arm_index"], artifact="arms")
    return items.select("pk", "sk", F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"]))), ";").alias("attrs"))


def orphan_sweep(spark, d):
    item = lambda df: df.select(F.concat(F.lit("run#"), F.col("wave")).alias("pk"), F.concat(F.lit("o#"), F.col("o_orderkey")).alias("sk"))
    base = offers(spark, d)
    return kv.orphans(item(base), item(base.where("wave IN (1996, 1997) AND o_orderkey % 3 <> 0")))


def union_by_name(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    left = s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    right = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return left.unionByName(right).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"))


def except_all_equality(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return incremental.missing_rows(a, a.where("l_linenumber < 7"))


def catalog_time_columns(spark, d):
    from quern.sources.tables import time_columns

    rows = [(t, c) for t in ("events", "orders", "lineitem", "customer") for c in time_columns(table(spark, d, t))]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def duplicate_offenders(spark, d):
    """The ten keys of line items that repeat most: what a refused merge reports."""
    return incremental.offenders(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicates_kept(spark, d):
    """Rows left by each policy for repeated keys."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    one = lambda policy: cleaning.by_duplicate_policy(lines, ["l_orderkey", "l_linenumber"], [F.col("l_orderkey")], policy).agg(F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n"))
    return one("keep").union(one("drop"))


def kv_item_types(spark, d):
    """Attributes of customers' items by name and store type."""
    made = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("in_credit"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nation"))
    return kv.items(made, "r1#customers", ["c_custkey"], lift=False).where("sk <> '#model'").select(F.explode("attrs").alias("name", "a")).groupBy("name", F.col("a.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


_TOTAL = "(SELECT count(*) FROM offers WHERE wave <= {})"
QUERIES = {
    "incremental_extract": (lambda spark, d: incremental.extract(offers(spark, d), "wave", "1998"), f"WITH {_OFFERS} SELECT * FROM offers WHERE CAST(wave AS VARCHAR) > '1998'"),
    "watermark_next": (
        watermark_next,
        f"WITH {_OFFERS} SELECT 1 AS run, {_TOTAL.format(1996)} AS extracted, NULL::VARCHAR AS watermark_before, '1996' AS watermark_after UNION ALL SELECT 2, {_TOTAL.format(1998)} - {_TOTAL.format(1996)}, '1996', '1998' UNION ALL SELECT 3, {_TOTAL.format(2001)} - {_TOTAL.format(1998)}, '1998', '2001' UNION ALL SELECT 4, 0, '2001', '2001'",
    ),
    "merge_upsert": (merge_upsert, f"WITH {_OFFERS} SELECT o_orderkey, wave, o_totalprice, CASE WHEN wave < 1997 THEN '?' ELSE o_orderstatus END AS o_orderstatus FROM offers"),
    "replace_by_run": (
        replace_by_run,
        f"WITH {_OFFERS} SELECT 'through-wave-' || wave AS run_id, o_orderkey, CASE WHEN wave = 1998 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM offers WHERE wave <> 1998 OR o_orderkey % 2 = 0",
    ),
    "kv_items": (
        kv_items,
        f"WITH {inputs.grid_sql()}, shown AS (SELECT *, CASE WHEN rate_ceil IS NULL THEN '' ELSE 'rate_ceil=' || rate_ceil::DECIMAL(12,0) || ';' END AS c, CASE WHEN rate_floor IS NULL THEN '' ELSE 'rate_floor=' || rate_floor::DECIMAL(12,0) || ';' END AS f FROM arms) "
        f"SELECT 'r1#arms' AS pk, 'risk_band#' || risk_band || '#arm_index#' || arm_index AS sk, 'arm_id=' || arm_id || ';arm_index=' || arm_index || ';' || c || f || 'risk_band=' || risk_band AS attrs FROM shown UNION ALL SELECT 'r1#arms', '#model', 'artifact=arms;artifact_rows={len(GRID.rows())};run=r1;version=3'",
    ),
    "orphan_sweep": (orphan_sweep, f"WITH {_OFFERS} SELECT 'run#' || wave AS pk, 'o#' || o_orderkey AS sk FROM offers WHERE wave IN (1996, 1997) AND o_orderkey % 3 = 0"),
    "star_stage_fact": (star_stage_fact, f"WITH {FACTS} SELECT offer_id, wave, arm_id, took_up = 1 AS took_up FROM facts WHERE wave >= (SELECT max(wave) FROM facts WHERE wave <= 2)"),
    "fact_parity": (
        fact_parity,
        f"WITH {FACTS} SELECT (SELECT count(*) FROM orders) AS spine, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS matched, count(*) FILTER (WHERE arm_id IS NULL) AS without_arm FROM facts",
    ),
    "duplicate_offenders": (duplicate_offenders, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 10"),
    "duplicates_kept": (duplicates_kept, "SELECT 'keep' AS policy, count(*) AS n FROM lineitem UNION ALL SELECT 'drop', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    "kv_item_types": (
        kv_item_types,
        "SELECT 'c_custkey' AS name, 'N' AS type, count(c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', 'S', count(c_name) FROM customer UNION ALL SELECT 'c_acctbal', 'N', count(c_acctbal) FROM customer UNION ALL SELECT 'in_credit', 'BOOL', count(c_acctbal) FROM customer UNION ALL SELECT 'nation', 'N', count(*) FILTER (WHERE c_nationkey > 3) FROM customer",
    ),
    "union_by_name": (union_by_name, "SELECT 'supplier' AS kind, s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY 2"),
    "except_all_equality": (except_all_equality, "WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT * FROM a WHERE l_linenumber < 7) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right"),
    "catalog_time_columns": (
        catalog_time_columns,
        "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('events', 'orders', 'lineitem', 'customer') AND (data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE')",
    ),
}
