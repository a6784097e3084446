"""The test tables in the roles the operators need, as frames and as SQL.

Ticks are ``events``: a symbol is an event type, the price its value plus one, the time order that of the
ids.  Contacts are ``orders`` with ``customer``.  Facts of the bandit are orders by priority and price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import bandit, bars
from quern.session import pin_utc

START_US = 1_704_067_200_000_000
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
HOURLY = bars.Calendar(START_US, START_US + 30 * bars.DAY, bars.HOUR)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("value").cast(bars.MONEY) + F.lit(1)
    qty = (F.col("event_id") % 7 + 1).cast(bars.MONEY)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), price.cast(bars.MONEY).alias("price"), qty.alias("qty"), (price * (F.col("event_id") % 7 + 1)).cast(bars.MONEY).alias("quote_qty"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_time_us"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"), (F.col("event_id") % 97 != 0).alias("is_best_match"),
    )


TICKS = """ticks AS (
  SELECT event_type AS symbol, event_id AS trade_id, CAST(CAST(value AS DECIMAL(18,8)) + 1 AS DECIMAL(18,8)) AS price,
    CAST(event_id % 7 + 1 AS DECIMAL(18,8)) AS qty, CAST((CAST(value AS DECIMAL(18,8)) + 1) * (event_id % 7 + 1) AS DECIMAL(18,8)) AS quote_qty,
    epoch_us(ts) AS event_time_us, event_id % 2 = 0 AS is_buyer_maker, event_id % 97 <> 0 AS is_best_match
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.dense_bars(ticks(spark, sf_dir), HOURLY, SYMBOLS)


def bars_sql(interval: int = bars.HOUR) -> str:
    return f"""bars AS (
  SELECT symbol, event_time_us - event_time_us % {interval} AS bar_us, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, trade_id) AS close, CAST(sum(qty) AS DECIMAL(28,8)) AS volume, CAST(sum(quote_qty) AS DECIMAL(28,8)) AS quote_volume, count(*) AS n_ticks,
    min(trade_id) AS first_trade_id, max(trade_id) AS last_trade_id,
    CAST(sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS DECIMAL(28,8)) AS taker_buy_qty,
    CAST(sum(CASE WHEN NOT is_buyer_maker THEN quote_qty ELSE 0 END) AS DECIMAL(28,8)) AS taker_buy_quote_qty, bool_and(is_best_match) AS all_best_match
  FROM ticks GROUP BY 1, 2)"""


def dense_sql(interval: int = bars.HOUR) -> str:
    slots = 30 * bars.DAY // interval
    last = START_US + 30 * bars.DAY - interval
    names = ", ".join(f"('{s}')" for s in SYMBOLS)
    return f"""WITH {TICKS}, {bars_sql(interval)}, grid AS (
  SELECT symbol, {START_US} + slot * {interval} AS bar_us FROM range({slots}) AS g(slot), (VALUES {names}) AS s(symbol)),
dense AS (
  SELECT g.symbol, g.bar_us, make_timestamp(g.bar_us) AS bar_open_time_utc, open, high, low, close, volume, quote_volume, coalesce(n_ticks, 0) AS n_ticks, first_trade_id, last_trade_id,
    taker_buy_qty, taker_buy_quote_qty, all_best_match, CASE WHEN n_ticks IS NULL THEN 1 ELSE 0 END AS is_missing_bar,
    CASE WHEN g.bar_us = {START_US} THEN 1 ELSE 0 END AS is_first_bar, CASE WHEN g.bar_us = {last} THEN 1 ELSE 0 END AS is_last_bar
  FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.bar_us = g.bar_us)"""


DENSE = dense_sql()

#: Declared cuts of the price by band; an order's priority is its band.
GRID = bandit.ArmGrid(
    {
        "1-URGENT": (100000.0, 200000.0, 300000.0, 350000.0, 400000.0),
        "2-HIGH": (80000.0, 150000.0, 250000.0, 350000.0, 450000.0),
        "3-MEDIUM": (90000.0, 180000.0, 270000.0, 360000.0, 430000.0),
        "4-NOT SPECIFIED": (50000.0, 100000.0, 200000.0, 300000.0, 400000.0),
        "5-LOW": (120000.0, 220000.0, 320000.0, 380000.0, 440000.0),
    }
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three waves of years with their arms."""
    year = F.year("o_orderdate")
    wave = F.when(year <= 1996, 1).when(year <= 1998, 2).otherwise(3)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offer_id"), wave.alias("wave"), F.col("o_orderpriority").alias("risk_band"), F.col("o_totalprice").alias("rate"), (F.col("o_orderstatus") == "F").cast("int").alias("took_up"))
    return GRID.join(orders.withColumnRenamed("risk_band", "band"), "band", "rate").withColumnRenamed("band", "risk_band")


def grid_sql() -> str:
    show = lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"
    rows = ", ".join(f"({a}, '{b}', {k}, {show(lo)}, {show(hi)})" for a, b, k, lo, hi in GRID.rows())
    return f"arms AS (SELECT * FROM (VALUES {rows}) AS v(arm_id, risk_band, arm_index, rate_floor, rate_ceil))"


FACTS = f"""{grid_sql()}, facts AS (
  SELECT o_orderkey AS offer_id, CASE WHEN year(o_orderdate) <= 1996 THEN 1 WHEN year(o_orderdate) <= 1998 THEN 2 ELSE 3 END AS wave, o_orderpriority AS risk_band,
    o_totalprice AS rate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS took_up, arm_id, arm_index
  FROM orders LEFT JOIN arms ON arms.risk_band = o_orderpriority AND (rate_floor IS NULL OR o_totalprice >= rate_floor) AND (rate_ceil IS NULL OR o_totalprice < rate_ceil))"""
CELLS = FACTS + """, cells AS (
  SELECT wave, risk_band, arm_id, arm_index, count(*) AS pulls, CAST(sum(took_up) AS BIGINT) AS rewards, min(rate) AS min_rate, max(rate) AS max_rate FROM facts GROUP BY ALL),
every AS (
  SELECT w.wave, a.risk_band, a.arm_id, a.arm_index, coalesce(pulls, 0) AS pulls, coalesce(rewards, 0) AS rewards
  FROM (SELECT DISTINCT wave FROM cells) w CROSS JOIN arms a LEFT JOIN cells c ON c.wave = w.wave AND c.arm_id = a.arm_id),
belief AS (
  SELECT wave AS through_wave, arm_id, risk_band, arm_index, CAST(sum(pulls) OVER w AS BIGINT) AS pulls, CAST(sum(rewards) OVER w AS BIGINT) AS rewards
  FROM every WINDOW w AS (PARTITION BY arm_id ORDER BY wave ROWS UNBOUNDED PRECEDING))"""
