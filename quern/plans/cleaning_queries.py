"""Cleaning, profiling, reconstruction and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cleaning, kpis
from quern.plans.inputs import table

#: Fixed values of this catalogue's own tables.
SECTORS = {"AUTOMOBILE": "Transport", "BUILDING": "Property", "FURNITURE": "Home", "HOUSEHOLD": "Home", "MACHINERY": "Industry"}
PRIORITY_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
_SECTOR_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in SECTORS.items())
_RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY_RANK.items())


def contacts(spark, d):
    """Orders with their customers, the month as date, and whether the order was fulfilled."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    lookup = spark.createDataFrame(list(SECTORS.items()), "c_mktsegment string, sector string")
    made = cleaning.join_small(joined, lookup, "c_mktsegment")
    return made.withColumns({"contact_month": F.trunc("o_orderdate", "month"), "y": (F.col("o_orderstatus") == "F").cast("int")})


CONTACTS = f"""contacts AS (
  SELECT o.*, c.*, sector, CAST(date_trunc('month', o_orderdate) AS DATE) AS contact_month, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
  FROM orders o JOIN customer c ON o_custkey = c_custkey LEFT JOIN (VALUES {_SECTOR_ROWS}) AS s(seg, sector) ON seg = c_mktsegment)"""


def mode_impute(spark, d):
    marked = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.col("o_orderstatus")).alias("status"))
    return cleaning.impute_modes(marked, ["priority", "status"])


def sentinel_to_null_flag(spark, d):
    marked = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, 999.0).otherwise(F.col("c_acctbal")).alias("balance"))
    return cleaning.sentinel_to_null(marked, "balance", 999.0, "has_balance")


def dedup_subset(spark, d):
    lines = table(spark, d, "lineitem")
    order = [F.col(c).asc_nulls_first() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return cleaning.deduplicate(lines, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def iqr_cap(spark, d):
    return cleaning.cap_at_fence(table(spark, d, "events"), "value", "value_capped").groupBy("event_type").agg(F.round(F.max("value_capped"), 6).alias("highest"), F.round(F.avg("value_capped"), 6).alias("mean"))


def age_band_case(spark, d):
    age = 18 + F.col("c_custkey") % 70
    band = F.when(age < 30, "young").when(age < 60, "middle").otherwise("senior")
    return table(spark, d, "customer").select(age.alias("age"), band.alias("age_group"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("in_credit")).groupBy("age_group").agg(F.count(F.lit(1)).alias("n"), F.sum("in_credit").alias("in_credit"))


def map_lookup(spark, d):
    ranked = table(spark, d, "orders").select("o_orderkey", cleaning.lookup(PRIORITY_RANK, "o_orderpriority").cast("bigint").alias("rank"))
    return ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def rollover_reconstruct(spark, d):
    hours = table(spark, d, "events").select("event_id", F.hour("ts").alias("hour"))
    return cleaning.rollovers(hours, "event_id", "hour", "day").select("event_id", "hour", F.col("day").cast("bigint").alias("day"))


def date_parts(spark, d):
    day = F.col("o_orderdate").cast("date")
    made = F.make_date(F.year(day), F.month(day), F.lit(1))
    return table(spark, d, "orders").select(
        "o_orderkey", made.alias("month_start"), F.quarter(day).alias("quarter"), F.when(F.quarter(day) == 4, 1).otherwise(0).alias("is_q4"),
        F.months_between(made, F.lit("1995-01-01").cast("date")).cast("int").alias("months_elapsed"), F.date_format(day, "MMMM").alias("month_name"), (made + F.expr("make_dt_interval(10)")).cast("date").alias("tenth_day_after"),
    )


def segment_kpis(spark, d):
    made = kpis.segment_kpis(contacts(spark, d), ["contact_month", "sector", "o_orderpriority"], "y", {"avg_price": "o_totalprice", "avg_balance": "c_acctbal"})
    return made.withColumns({c: F.round(c, 6) for c in ("subscribe_rate", "avg_price", "avg_balance")})


def monthly_kpis(spark, d):
    made = kpis.monthly_kpis(contacts(spark, d), "contact_month", "y", "c_mktsegment", "sector", {"avg_price": "o_totalprice"})
    return made.withColumns({c: F.round(c, 6) for c in ("subscribe_rate", "avg_price")})


def pivot_avg(spark, d):
    made = kpis.pivot_mean(contacts(spark, d), "sector", "o_orderstatus", ["F", "O", "P", "X"], "o_totalprice")
    return made.select("sector", *[F.round(F.col(c), 6).alias(f"status_{c}") for c in ("F", "O", "P", "X")])


def null_profile(spark, d):
    marked = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("c_nationkey"))
    return cleaning.null_profile(marked)


def text_normalise_check(spark, d):
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    made = table(spark, d, "part").select(name.alias("raw"), "p_name")
    clean = cleaning.normalise_text("raw")
    return made.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("raw") != clean).alias("changed"), F.count_if(clean == F.lower("p_name")).alias("restored"), F.countDistinct(clean).alias("distinct_names"))


def split_extract_text(spark, d):
    parts = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.get(parts, 0).alias("first_word"), F.get(parts, 5).alias("sixth_word"), F.size(parts).cast("bigint").alias("n_words"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_number"), F.regexp_extract("p_name", r"(\d+)", 1).alias("digits"),
        F.regexp_replace("p_brand", "Brand", "B").alias("brand_short"), F.col("p_brand").contains("#1").alias("in_tens"), F.col("p_name").try_cast("int").alias("as_number"),
    )


def quantile_profile(spark, d):
    points = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = cleaning.percentiles(table(spark, d, "lineitem"), ["l_extendedprice"], points, between=False)
    return found.select(F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("p"), F.col("l_extendedprice").alias("value"))).alias("z")).select(F.col("z.p").alias("p"), F.col("z.value").alias("value"))


QUERIES = {
    "mode_impute": (
        mode_impute,
        "WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE o_orderstatus END AS status FROM orders), "
        "p AS (SELECT priority FROM m WHERE priority <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), s AS (SELECT status FROM m WHERE status <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
        "SELECT o_orderkey, CASE WHEN priority = 'unknown' THEN (SELECT * FROM p) ELSE priority END AS priority, CASE WHEN status = 'unknown' THEN (SELECT * FROM s) ELSE status END AS status FROM m",
    ),
    "sentinel_to_null_flag": (
        sentinel_to_null_flag,
        "WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 999.0::DOUBLE ELSE c_acctbal END AS balance FROM customer) SELECT c_custkey, nullif(balance, 999.0) AS balance, CASE WHEN balance <> 999.0 THEN 1 ELSE 0 END AS has_balance FROM m",
    ),
    "dedup_subset": (
        dedup_subset,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST) AS r FROM lineitem) WHERE r = 1",
    ),
    "iqr_cap": (
        iqr_cap,
        "WITH q AS (SELECT quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS b FROM events) SELECT event_type, round(max(least(value, b + 1.5 * (b - a))), 6) AS highest, round(avg(least(value, b + 1.5 * (b - a))), 6) AS mean FROM events, q GROUP BY 1",
    ),
    "outlier_report": (
        lambda spark, d: cleaning.outliers(table(spark, d, "events"), "value"),
        "WITH q AS (SELECT quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS b, avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT count(*) AS n_rows, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outside_fences, count(*) FILTER (WHERE abs(value - m) > 3 * s) AS beyond_three_sigma FROM events, q",
    ),
    "age_band_case": (
        age_band_case,
        "SELECT CASE WHEN 18 + c_custkey % 70 < 30 THEN 'young' WHEN 18 + c_custkey % 70 < 60 THEN 'middle' ELSE 'senior' END AS age_group, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_credit FROM customer GROUP BY 1",
    ),
    "map_lookup": (map_lookup, f"SELECT CAST(CASE o_orderpriority {_RANKS} END AS BIGINT) AS rank, count(*) AS n FROM orders GROUP BY 1"),
    "rollover_reconstruct": (
        rollover_reconstruct,
        "WITH h AS (SELECT event_id, hour(ts) AS hour, lag(hour(ts)) OVER (ORDER BY event_id) AS before FROM events) SELECT event_id, CAST(hour AS INTEGER) AS hour, CAST(sum(CASE WHEN hour < before THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS day FROM h",
    ),
    "date_parts": (
        date_parts,
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CASE WHEN quarter(o_orderdate) = 4 THEN 1 ELSE 0 END AS is_q4, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS months_elapsed, monthname(o_orderdate) AS month_name, CAST(date_trunc('month', o_orderdate) + INTERVAL 10 DAY AS DATE) AS tenth_day_after FROM orders",
    ),
    "sector_broadcast_join": (
        lambda spark, d: contacts(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sector").isNull()).alias("unmatched")),
        f"WITH {CONTACTS} SELECT sector, count(*) AS n, count(*) FILTER (WHERE sector IS NULL) AS unmatched FROM contacts GROUP BY 1",
    ),
    "segment_kpis": (
        segment_kpis,
        f"WITH {CONTACTS} SELECT contact_month, sector, o_orderpriority, count(*) AS contacts, CAST(sum(y) AS BIGINT) AS subscribed, round(avg(y), 6) AS subscribe_rate, round(avg(o_totalprice), 6) AS avg_price, round(avg(c_acctbal), 6) AS avg_balance FROM contacts GROUP BY 1, 2, 3",
    ),
    "monthly_kpis": (
        monthly_kpis,
        f"WITH {CONTACTS}, t AS (SELECT contact_month, sector, row_number() OVER (PARTITION BY contact_month ORDER BY count(*) DESC, sector DESC) AS r FROM contacts GROUP BY 1, 2) "
        "SELECT c.contact_month, count(*) AS contacts, count(DISTINCT c_mktsegment) AS unique_values, CAST(sum(y) AS BIGINT) AS subscribed, round(avg(y), 6) AS subscribe_rate, round(avg(o_totalprice), 6) AS avg_price, any_value(t.sector) AS top_sector FROM contacts c JOIN t ON t.contact_month = c.contact_month AND r = 1 GROUP BY 1",
    ),
    "argmax_struct": (
        lambda spark, d: kpis.argmax_by_count(contacts(spark, d), "o_orderpriority", "c_mktsegment", "top_segment"),
        f"WITH {CONTACTS} SELECT o_orderpriority, c_mktsegment AS top_segment FROM (SELECT o_orderpriority, c_mktsegment, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, c_mktsegment DESC) AS r FROM contacts GROUP BY 1, 2) WHERE r = 1",
    ),
    "pivot_avg": (
        pivot_avg,
        f"WITH {CONTACTS} SELECT sector, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{c}'), 6) AS status_{c}" for c in "FOPX") + " FROM contacts GROUP BY 1",
    ),
    "null_profile": (
        null_profile,
        "SELECT 'c_custkey' AS column_name, 0::BIGINT AS nulls UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE NOT c_acctbal >= 0) FROM customer UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE NOT c_nationkey > 3) FROM customer",
    ),
    "distinct_profile": (
        lambda spark, d: cleaning.distinct_profile(table(spark, d, "part"), ["p_brand", "p_type", "p_name"]),
        "SELECT 'p_brand' AS column_name, count(DISTINCT p_brand) AS distinct_values FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part",
    ),
    "text_normalise_check": (
        text_normalise_check,
        "SELECT count(*) AS n_rows, count(*) FILTER (WHERE '  ' || upper(p_name) || ' ' <> lower(trim('  ' || upper(p_name) || ' '))) AS changed, count(*) FILTER (WHERE lower(trim('  ' || upper(p_name) || ' ')) = lower(p_name)) AS restored, count(DISTINCT lower(trim(p_name))) AS distinct_names FROM part",
    ),
    "split_extract_text": (
        split_extract_text,
        r"SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[6] AS sixth_word, len(string_split(p_name, ' ')) AS n_words, regexp_extract(p_brand, '#(\d+)', 1) AS brand_number, regexp_extract(p_name, '(\d+)', 1) AS digits, replace(p_brand, 'Brand', 'B') AS brand_short, contains(p_brand, '#1') AS in_tens, try_cast(p_name AS INTEGER) AS as_number FROM part",
    ),
    "histogram_30": (
        lambda spark, d: cleaning.histogram(table(spark, d, "events"), "value", 30),
        "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) AS BIGINT) AS bin, count(*) AS n FROM events, s GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM range(30) r(bin) LEFT JOIN h ON h.bin = r.bin",
    ),
    "quantile_profile": (quantile_profile, "SELECT p::DOUBLE AS p, q AS value FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS p, unnest(quantile_disc(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99])) AS q FROM lineitem)"),
    "running_totals": (
        lambda spark, d: cleaning.running_count(table(spark, d, "events").select("event_id", "event_type"), "event_id", F.col("event_type") == "purchase", "purchases").select("event_id", F.col("purchases").cast("bigint").alias("purchases")),
        "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS purchases FROM events",
    ),
}
