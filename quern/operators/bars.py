"""Event rows to dense, calendar-based OHLCV bars with exact decimal aggregates.

Money stays decimal, so sums do not depend on partitioning.  Open and close go by the strictly increasing
trade id (``min_by``/``max_by``: hash aggregation, one shuffle).  The calendar is declared, never read
off the data; missing bars are flagged, never filled, but for their count of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND
MONEY, TOTAL = T.DecimalType(18, 8), T.DecimalType(28, 8)

#: The bar table's columns, in the order that readers rely on.
BAR_COLUMNS = (
    "symbol", "bar_us", "bar_open_time_utc", "open", "high", "low", "close", "volume", "quote_volume", "n_ticks", "first_trade_id", "last_trade_id",
    "taker_buy_qty", "taker_buy_quote_qty", "all_best_match", "is_missing_bar", "is_first_bar", "is_last_bar",
)


@dataclass(frozen=True)
class Calendar:
    """A declared half-open span [start, end) of microseconds, tiled by ``interval``."""

    start_us: int
    end_us: int
    interval_us: int

    def __post_init__(self) -> None:
        if self.interval_us <= 0 or self.end_us <= self.start_us:
            raise ValueError("a calendar needs a positive interval and an end after its start")
        if self.start_us % self.interval_us or (self.end_us - self.start_us) % self.interval_us:
            raise ValueError("the interval must tile the calendar from its start to its end")

    @property
    def slots(self) -> int:
        return (self.end_us - self.start_us) // self.interval_us

    def grid(self, spark: SparkSession, symbols: list[str]) -> DataFrame:
        """One row a slot and symbol; the symbols are few, so each task crosses its slots with them."""
        keys = F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")
        return spark.range(self.slots).select(keys, (F.lit(self.start_us) + F.col("id") * self.interval_us).alias("bar_us"))


def bucket(time_us: str, interval_us: int):
    """The start of the half-open bucket, right for times before the epoch too."""
    return F.col(time_us) - F.pmod(F.col(time_us), F.lit(interval_us))


def aggregate(ticks: DataFrame, interval_us: int) -> DataFrame:
    """One row a symbol and non-empty bucket, the guard sums among them: fifteen aggregates in one shuffle."""
    sells = F.col("is_buyer_maker")
    nulls = F.greatest(*[F.col(c).isNull().cast("int") for c in ("trade_id", "price", "qty", "quote_qty", "event_time_us", "is_buyer_maker", "is_best_match")])
    zero = F.lit(0).cast(MONEY)
    return (
        ticks.withColumn("bar_us", bucket("event_time_us", interval_us))
        .groupBy("symbol", "bar_us")
        .agg(
            F.min_by("price", "trade_id").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "trade_id").alias("close"),
            F.sum("qty").cast(TOTAL).alias("volume"),
            F.sum("quote_qty").cast(TOTAL).alias("quote_volume"),
            F.count(F.lit(1)).alias("n_ticks"),
            F.min("trade_id").alias("first_trade_id"),
            F.max("trade_id").alias("last_trade_id"),
            F.sum(F.when(~sells, F.col("qty")).otherwise(zero)).cast(TOTAL).alias("taker_buy_qty"),
            F.sum(F.when(~sells, F.col("quote_qty")).otherwise(zero)).cast(TOTAL).alias("taker_buy_quote_qty"),
            F.bool_and("is_best_match").alias("all_best_match"),
            F.sum(nulls).alias("guard_nulls"),
            F.count_if(F.col("qty") <= 0).alias("guard_no_qty"),
            F.count_if(F.col("price") <= 0).alias("guard_no_price"),
            F.count_if(~F.col("is_best_match")).alias("guard_not_best"),
        )
    )


def densify(bars: DataFrame, calendar: Calendar, symbols: list[str]) -> DataFrame:
    """The full grid with bars joined on, missing slots flagged, first and last slots marked."""
    grid = calendar.grid(bars.sparkSession, symbols)
    joined = grid.join(bars, ["symbol", "bar_us"], "left")
    flag = lambda test: F.when(test, 1).otherwise(0)
    return joined.withColumns(
        {
            "is_missing_bar": flag(F.col("n_ticks").isNull()),
            "is_first_bar": flag(F.col("bar_us") == calendar.start_us),
            "is_last_bar": flag(F.col("bar_us") == calendar.end_us - calendar.interval_us),
            "bar_open_time_utc": F.timestamp_micros("bar_us"),
            "n_ticks": F.coalesce("n_ticks", F.lit(0).cast("bigint")),
        }
    )


def dense_bars(ticks: DataFrame, calendar: Calendar, symbols: list[str]) -> DataFrame:
    return densify(aggregate(ticks, calendar.interval_us), calendar, symbols).select(*BAR_COLUMNS)


def invariants(dense: DataFrame, ticks: DataFrame) -> DataFrame:
    """One row of eight counts of breaches, and the rows read against the ticks binned; all breaches are 0 in sound bars."""
    full = F.col("n_ticks") > 0
    made = dense.agg(
        F.sum("n_ticks").alias("binned"),
        F.sum(F.coalesce("guard_nulls", F.lit(0))).cast("bigint").alias("null_values"),
        F.count_if(full & (F.col("high") < F.greatest("open", "close", "low"))).alias("high_breaches"),
        F.count_if(full & (F.col("low") > F.least("open", "close", "high"))).alias("low_breaches"),
        F.count_if(full & (F.col("taker_buy_qty") > F.col("volume"))).alias("taker_breaches"),
        F.sum(F.coalesce("guard_no_qty", F.lit(0))).cast("bigint").alias("zero_quantities"),
        F.sum(F.coalesce("guard_no_price", F.lit(0))).cast("bigint").alias("zero_prices"),
        F.sum(F.coalesce("guard_not_best", F.lit(0))).cast("bigint").alias("not_best_match"),
    )
    read = ticks.agg(F.count(F.lit(1)).alias("read"))
    return made.join(read).select("read", "binned", (F.col("read") - F.col("binned")).alias("lost"), "null_values", "high_breaches", "low_breaches", "taker_breaches", "zero_quantities", "zero_prices", "not_best_match")


def assert_sound(dense: DataFrame, ticks: DataFrame) -> None:
    row = invariants(dense, ticks).first().asDict()
    bad = {k: v for k, v in row.items() if v and k not in ("read", "binned", "not_best_match")}
    if bad:
        raise ValueError(f"bars break their invariants: {bad}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: keys that occur more than once, and the rows beyond each key's first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.agg(F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra_rows"))


def contiguity(ticks: DataFrame, symbol: str = "symbol", key: str = "trade_id") -> DataFrame:
    """Per symbol: rows, id span, and whether the ids run on without gap or repeat."""
    out = ticks.groupBy(symbol).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    span = F.col("last_id") - F.col("first_id") + 1
    return out.withColumns({"id_span": span, "contiguous": span == F.col("n_rows")})


def assert_contiguous(ticks: DataFrame) -> None:
    """Raises on gaps before duplicates are looked at: a repeated id shows as one too."""
    broken = [r["symbol"] for r in contiguity(ticks).where("NOT contiguous").collect()]
    if broken:
        raise ValueError(f"trade ids are not contiguous for {broken}")


def tie_groups(ticks: DataFrame) -> DataFrame:
    """Per symbol: times that several ticks share, the ticks in them, and times at which the price is ambiguous."""
    shared = ticks.groupBy("symbol", "event_time_us").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("price").alias("prices")).where("n > 1")
    return shared.groupBy("symbol").agg(F.count(F.lit(1)).alias("tied_times"), F.sum("n").alias("tied_ticks"), F.count_if(F.col("prices") > 1).alias("ambiguous_times"), F.max("n").alias("largest_tie"))


def fanout(ticks: DataFrame, *grains_us: int) -> DataFrame:
    """The rows that a self-join on the event time would make at each grain, counted without joining.

    A grain that the one before divides is rolled up from its counts, so ticks are read once for a chain of grains.
    """
    out, before, finer = None, None, 0
    for grain in sorted(grains_us):
        source = ticks.select(F.col("event_time_us").alias("t"), F.lit(1).alias("n")) if before is None or grain % finer else before
        counted, finer = source.groupBy(bucket("t", grain).alias("t")).agg(F.sum("n").alias("n")), grain
        before = counted
        one = counted.agg(F.sum("n").alias("rows_in"), F.sum(F.col("n") * F.col("n")).alias("rows_joined"), F.max("n").alias("largest_key")).select(F.lit(grain).cast("bigint").alias("grain_us"), "rows_in", "rows_joined", "largest_key")
        out = one if out is None else out.unionByName(one)
    return out


REQUIRED = ("symbol", "bar_us", "open", "high", "low", "close", "volume", "n_ticks", "is_missing_bar")


@dataclass(frozen=True)
class LoadedBars:
    bars: DataFrame
    symbols: list[str]
    interval_us: int
    slots: int
    rows: int


def load_bars(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> LoadedBars:
    """A bar table that has the columns asked for and is dense: every symbol on every slot of one tiled span."""
    bars = spark.read.parquet(path)
    if missing := [c for c in required if c not in bars.columns]:
        raise ValueError(f"{path} lacks {missing}")
    times = bars.select("bar_us").distinct().agg(F.count(F.lit(1)).alias("slots"), F.min("bar_us").alias("lo"), F.max("bar_us").alias("hi")).first()
    per = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bar_us").alias("d")).collect()
    rows = sum(r["n"] for r in per)
    if not rows:
        raise ValueError(f"{path} is empty")
    slots = times["slots"]
    if slots < 2:
        raise ValueError(f"{path} has fewer than two slots")
    interval, rest = divmod(times["hi"] - times["lo"], slots - 1)
    if rest or bars.where(F.pmod(F.col("bar_us") - times["lo"], F.lit(interval)) != 0).limit(1).count():
        raise ValueError(f"{path}: the slots do not tile their span")
    if any(r["n"] != slots or r["d"] != slots for r in per):
        raise ValueError(f"{path} is not dense: {[(r['symbol'], r['n']) for r in per if r['n'] != slots]}")
    return LoadedBars(bars, sorted(r["symbol"] for r in per), interval, slots, rows)
