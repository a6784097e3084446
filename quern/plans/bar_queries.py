"""Bars: aggregation, the dense calendar and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bars, cleaning
from quern.plans import inputs
from quern.plans.inputs import DENSE, HOURLY, SYMBOLS, TICKS, bars_sql

_BARE = ", ".join(c for c in bars.BAR_COLUMNS if c not in ("bar_open_time_utc", "is_missing_bar", "is_first_bar", "is_last_bar"))


def ohlcv_bars(spark, sf_dir):
    return bars.aggregate(inputs.ticks(spark, sf_dir), bars.HOUR).drop("guard_nulls", "guard_no_qty", "guard_no_price", "guard_not_best")


def missing_bar_rate(spark, sf_dir):
    made = inputs.hourly(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("slots"), F.sum("is_missing_bar").alias("missing"))
    return made.withColumn("missing_rate", F.round(F.col("missing") / F.col("slots"), 9)).withColumn("fires", F.col("missing_rate") > 0.05)


def bar_invariants(spark, sf_dir):
    ticks = inputs.ticks(spark, sf_dir)
    return bars.invariants(bars.densify(bars.aggregate(ticks, bars.HOUR), HOURLY, SYMBOLS), ticks)


def taker_imbalance(spark, sf_dir):
    made = inputs.hourly(spark, sf_dir).where("is_missing_bar = 0")
    ratio = F.try_divide(2 * F.col("taker_buy_qty") - F.col("volume"), F.col("volume")).cast("double")
    return made.groupBy("symbol").agg(F.round(F.avg(ratio), 8).alias("mean_imbalance"), F.count_if(F.col("taker_buy_qty") == 0).alias("all_sell_bars"))


def tick_direction_given_flag(spark, sf_dir):
    made = cleaning.following(inputs.ticks(spark, sf_dir), "symbol", "trade_id", "price", "next_price").where("next_price IS NOT NULL AND next_price <> price")
    return made.groupBy("symbol", "is_buyer_maker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("next_price") > F.col("price")).cast("double")), 9).alias("p_up"))


def interval_sweep(spark, sf_dir):
    """Non-empty bars and the largest bar at each interval; ticks are counted once, at the finest, and rolled up."""
    finest = inputs.ticks(spark, sf_dir).groupBy("symbol", bars.bucket("event_time_us", bars.HOUR).alias("t")).agg(F.count(F.lit(1)).alias("n")).persist()
    out = None
    for interval in (bars.HOUR, 2 * bars.HOUR, 6 * bars.HOUR, bars.DAY):
        made = finest.groupBy("symbol", bars.bucket("t", interval).alias("bar_us")).agg(F.sum("n").alias("n"))
        one = made.agg(F.count(F.lit(1)).alias("filled"), F.max("n").alias("largest")).select(F.lit(interval).cast("bigint").alias("interval_us"), F.lit(30 * bars.DAY // interval * len(SYMBOLS)).cast("bigint").alias("slots"), "filled", "largest")
        out = one if out is None else out.unionByName(one)
    return out


_SWEEP = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS interval_us, CAST({30 * bars.DAY // i * len(SYMBOLS)} AS BIGINT) AS slots, count(*) AS filled, max(n) AS largest FROM (SELECT symbol, event_time_us - event_time_us % {i} AS b, count(*) AS n FROM ticks GROUP BY 1, 2)"
    for i in (bars.HOUR, 2 * bars.HOUR, 6 * bars.HOUR, bars.DAY)
)
_FANOUT = " UNION ALL ".join(
    f"SELECT CAST({g} AS BIGINT) AS grain_us, CAST(sum(n) AS BIGINT) AS rows_in, CAST(sum(n * n) AS BIGINT) AS rows_joined, max(n) AS largest_key FROM (SELECT event_time_us - event_time_us % {g} AS t, count(*) AS n FROM ticks GROUP BY 1)" for g in (1, 1000, bars.SECOND, bars.HOUR)
)

QUERIES = {
    "ohlcv_bars": (ohlcv_bars, f"WITH {TICKS}, {bars_sql()} SELECT {_BARE} FROM bars"),
    "dense_calendar_bars": (inputs.hourly, f"{DENSE} SELECT {', '.join(bars.BAR_COLUMNS)} FROM dense"),
    "missing_bar_rate": (
        missing_bar_rate,
        f"{DENSE} SELECT symbol, count(*) AS slots, CAST(sum(is_missing_bar) AS BIGINT) AS missing, round(sum(is_missing_bar) / count(*), 9) AS missing_rate, round(sum(is_missing_bar) / count(*), 9) > 0.05 AS fires FROM dense GROUP BY symbol",
    ),
    "dup_key_count": (
        lambda spark, d: bars.duplicate_keys(inputs.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"),
        "SELECT count(*) AS duplicated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
    "contiguity_profile": (
        lambda spark, d: bars.contiguity(inputs.ticks(spark, d)),
        f"WITH {TICKS} SELECT symbol, count(*) AS n_rows, min(trade_id) AS first_id, max(trade_id) AS last_id, max(trade_id) - min(trade_id) + 1 AS id_span, max(trade_id) - min(trade_id) + 1 = count(*) AS contiguous FROM ticks GROUP BY symbol",
    ),
    "bar_invariants": (
        bar_invariants,
        f"WITH {TICKS}, {bars_sql()}, g AS (SELECT count(*) AS read, count(*) FILTER (WHERE price IS NULL OR qty IS NULL) AS null_values, count(*) FILTER (WHERE qty <= 0) AS zero_quantities, count(*) FILTER (WHERE price <= 0) AS zero_prices, count(*) FILTER (WHERE NOT is_best_match) AS not_best_match FROM ticks) "
        "SELECT any_value(read) AS read, CAST(sum(n_ticks) AS BIGINT) AS binned, CAST(any_value(read) - sum(n_ticks) AS BIGINT) AS lost, any_value(null_values) AS null_values, count(*) FILTER (WHERE high < greatest(open, close, low)) AS high_breaches, count(*) FILTER (WHERE low > least(open, close, high)) AS low_breaches, "
        "count(*) FILTER (WHERE taker_buy_qty > volume) AS taker_breaches, any_value(zero_quantities) AS zero_quantities, any_value(zero_prices) AS zero_prices, any_value(not_best_match) AS not_best_match FROM bars, g",
    ),
    "tie_group_profile": (
        lambda spark, d: bars.tie_groups(inputs.ticks(spark, d).withColumn("event_time_us", bars.bucket("event_time_us", bars.MINUTE))),
        f"WITH {TICKS} SELECT symbol, count(*) AS tied_times, CAST(sum(n) AS BIGINT) AS tied_ticks, count(*) FILTER (WHERE prices > 1) AS ambiguous_times, max(n) AS largest_tie FROM (SELECT symbol, event_time_us - event_time_us % {bars.MINUTE} AS t, count(*) AS n, count(DISTINCT price) AS prices FROM ticks GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY symbol",
    ),
    "fanout_join_count": (lambda spark, d: bars.fanout(inputs.ticks(spark, d), 1, 1000, bars.SECOND, bars.HOUR), f"WITH {TICKS} {_FANOUT}"),
    "taker_imbalance": (
        taker_imbalance,
        f"{DENSE} SELECT symbol, round(avg((2 * taker_buy_qty - volume) / volume), 8) AS mean_imbalance, count(*) FILTER (WHERE taker_buy_qty = 0) AS all_sell_bars FROM dense WHERE is_missing_bar = 0 GROUP BY symbol",
    ),
    "tick_direction_given_flag": (
        tick_direction_given_flag,
        f"WITH {TICKS}, n AS (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY trade_id) AS next_price FROM ticks) SELECT symbol, is_buyer_maker, count(*) AS n, round(avg(CASE WHEN next_price > price THEN 1.0 ELSE 0.0 END), 9) AS p_up FROM n WHERE next_price IS NOT NULL AND next_price <> price GROUP BY 1, 2",
    ),
    "interval_sweep": (interval_sweep, f"WITH {TICKS} {_SWEEP}"),
}
