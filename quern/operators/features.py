"""Targets, features and topology of dense bars, for the continuous and the categorical path."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import cleaning

#: Rank of the classes, which the classifier's labels keep.
CLASSES = ("down", "flat", "up")
MISSING_STATE = "SYSTEM_STATE_UNKNOWN"


def per_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("bar_us")


def ratio(above: Column, below: Column) -> Column:
    """A ratio of exact decimals, NULL over zero.

    The division is in double: Spark's decimal quotient of two wide sums keeps six or seven digits only.
    """
    return F.try_divide(above.cast("double"), below.cast("double"))


def log_ratio(above: Column, below: Column) -> Column:
    return F.log(ratio(above, below))


def continuous(bars: DataFrame) -> DataFrame:
    """The next bar's log return as target ``y``, and scale-free features."""
    w = per_symbol()
    close = F.col("close")
    return bars.withColumns(
        {
            "y": log_ratio(F.lead("close").over(w), close),
            "ret1": log_ratio(close, F.lag("close").over(w)),
            "range_bp": ratio(F.col("high") - F.col("low"), close) * 10000,
            "body_bp": ratio(close - F.col("open"), close) * 10000,
            "imbalance": ratio(F.col("taker_buy_quote_qty"), F.col("quote_volume")),
            "log_qv": F.log(F.col("quote_volume").cast("double")),
        }
    )


def crosses(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "x_imb_ret": F.col("imbalance") * F.col("ret1"),
            "x_range_qv": F.col("range_bp") * F.col("log_qv"),
            "x_imb_range": F.col("imbalance") * F.col("range_bp"),
            "x_ret_ticks": F.col("ret1") * F.col("n_ticks").cast("double"),
        }
    )


def null_anatomy(df: DataFrame) -> DataFrame:
    """One row: missing targets by cause; a last bar that is empty itself counts as empty only."""
    gone, tail, own = F.col("y").isNull(), F.col("is_last_bar") == 1, F.col("is_missing_bar") == 1
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(gone).alias("missing"), F.count_if(gone & own).alias("own_bar_empty"),
        F.count_if(gone & tail & ~own).alias("end_of_calendar"), F.count_if(gone & ~own & ~tail).alias("next_bar_empty"),
    )


def target_class(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat")


def categorical(bars: DataFrame) -> DataFrame:
    """The next bar's direction as target, from exact decimal differences, and features."""
    taker, volume = F.col("taker_buy_qty"), F.col("volume")
    return bars.withColumns(
        {
            "y_class": target_class(F.lead("close").over(per_symbol()) - F.col("close")),
            "imbalance": ratio(2 * taker - volume, volume),
            "log_range": log_ratio(F.col("high"), F.col("low")),
            "body": ratio(F.col("close") - F.col("open"), F.col("open")),
            "ticks": F.col("n_ticks").cast("double"),
            "best_match_state": F.col("all_best_match").cast("string"),
        }
    )


def class_balance(df: DataFrame, column: str = "y_class") -> DataFrame:
    known = df.where(F.col(column).isNotNull())
    total = known.agg(F.count(F.lit(1)).alias("total"))
    return known.groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(total).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def fill_group_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """NULLs become their group's exact median; the medians are one row a group, whose number decides whether they are broadcast."""
    found = cleaning.percentiles(df, columns, [0.5], group)
    medians = found.select(F.col(group).alias("_of"), *[F.get(c, 0).alias(f"_median_{c}") for c in columns])
    joined = df.join(medians, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in columns}).drop(*[f"_median_{c}" for c in columns])


def fill_state(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(MISSING_STATE, subset=columns)


def cyclical(column: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of ``period``."""
    angle = column.cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clock_features(df: DataFrame, time: str) -> DataFrame:
    minute, hour = F.minute(time), F.hour(time)
    (ms, mc), (hs, hc) = cyclical(minute, 60), cyclical(hour, 24)
    return df.withColumns({"minute_sin": ms, "minute_cos": mc, "hour_sin": hs, "hour_cos": hc})


def categorical_crosses(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "x_imb_body": F.col("imbalance") * F.col("body"),
            "x_ticks_range": F.col("ticks") * F.col("log_range"),
            "x_imb_minute": F.col("imbalance") * F.col("minute_sin"),
            "symbol_state": F.concat_ws("__", "symbol", "best_match_state"),
        }
    )


def signed_log1p(column: Column) -> Column:
    return F.signum(column) * F.log1p(F.abs(column))


def correlation_long(df: DataFrame, columns: list[str], group: str | None = None, digits: int = 12) -> DataFrame:
    """Every pair's Pearson coefficient in long form, rounded, NaN as NULL: all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    names = [f"c{k}" for k in range(len(pairs))]
    by = [group] if group else []
    made = df.groupBy(*by).agg(*[F.corr(a, b).alias(n) for (a, b), n in zip(pairs, names, strict=True)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.nanvl(F.col(n), F.lit(None).cast("double")).alias("r")) for (a, b), n in zip(pairs, names, strict=True)])).alias("p")
    return made.select(*by, rows).select(*by, "p.column_a", "p.column_b", F.round("p.r", digits).alias("r"))


def sign_flips(pooled: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row: group cells whose sign is not the pooled one, and cells without a value."""
    both = grouped.join(pooled.select("column_a", "column_b", F.col("r").alias("pooled")), ["column_a", "column_b"])
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.signum("r") * F.signum("pooled") < 0).alias("flips"), F.count_if(F.col("r").isNull()).alias("undefined"))


def density(df: DataFrame, column: str) -> DataFrame:
    """One row: moments (sample deviation, population skewness and kurtosis) and exact quantiles."""
    known = df.where(F.col(column).isNotNull())
    q = cleaning.percentiles(known, [column], [0.01, 0.25, 0.5, 0.75, 0.99]).select(F.col(column).alias("q"))
    # Two tables of one row each.
    made = known.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("sd"), F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis")).join(q, how="left")
    return made.select("n", "mean", "sd", "skewness", "kurtosis", *[F.get("q", k).alias(n) for k, n in enumerate(("p01", "p25", "p50", "p75", "p99"))])


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column ``oh__<column>__<level>`` for each declared level."""
    return df.withColumns({f"oh__{column}__{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in levels})


def level_variances(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """One row a level: the sample variance of its 0/1 column."""
    made = df.agg(*[F.var_samp(F.when(F.col(column) == v, 1.0).otherwise(0.0)).alias(f"v{k}") for k, v in enumerate(levels)])
    return made.select(F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"v{k}").alias("variance")) for k, v in enumerate(levels)])).alias("p")).select("p.*")


def index_code_variance(df: DataFrame, column: str) -> DataFrame:
    """One row: the variance of integer codes given by frequency and by alphabet, which an order alone moves."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # One row a level.
    by_frequency = F.row_number().over(Window.orderBy(F.desc("n"), column)) - 1
    by_alphabet = F.row_number().over(Window.orderBy(column)) - 1
    codes = counts.withColumns({"f": by_frequency, "a": by_alphabet})
    n, total = F.col("n").cast("double"), F.sum(F.col("n").cast("double"))
    variance = lambda c: (F.sum(n * F.col(c) * F.col(c)) - F.sum(n * F.col(c)) * F.sum(n * F.col(c)) / total) / (total - 1)
    return codes.agg(variance("f").alias("by_frequency"), variance("a").alias("by_alphabet"))


def time_blocks(df: DataFrame, folds: int, lo: int, hi: int, time: str = "bar_us") -> DataFrame:
    """The fold of each row: ``folds`` equal blocks of [lo, hi]."""
    width = (hi - lo + 1) / folds
    return df.withColumn("fold", F.least(F.lit(folds - 1), F.floor((F.col(time) - F.lit(lo)) / F.lit(width))).cast("int"))


def fold_cut(share: float, lo: int, hi: int) -> int:
    return lo + int(share * (hi - lo))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation; 0 where a column does not vary."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev(c).alias(f"_s_{c}") for c in columns])
    scaled = {f"{c}_std": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.join(moments).withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def rank_scale(df: DataFrame, column: str, into: str, group: str) -> DataFrame:
    """percent_rank within each group (NULLs first)."""
    return df.withColumn(into, F.percent_rank().over(Window.partitionBy(group).orderBy(F.col(column).asc_nulls_first())))


def rank_cuts(df: DataFrame, columns: list[str], cuts: int = 1000) -> dict[str, list[float]]:
    """The quantiles of some rows, ``cuts`` + 1 a column: what ``rank_by_cuts`` ranks other rows against."""
    found = df.approxQuantile(columns, [k / cuts for k in range(cuts + 1)], 1 / (4 * cuts))
    return dict(zip(columns, found, strict=True))


def rank_by_cuts(df: DataFrame, column: str, into: str, points: list[float]) -> DataFrame:
    """An approximate rank from fitted quantiles, by binary search: no window over the whole table."""
    cuts = len(points) - 1
    distinct = sorted(set(points))
    if not distinct:
        return df.withColumn(into, F.lit(None).cast("double"))
    # Cuts below a value less one, for the values of each interval between distinct cuts; a value equal to a cut is above the ones before.
    below = [sum(1 for p in points if p < v) for v in distinct]
    shares = F.array(*[F.lit(max(n - 1, 0) / max(cuts, 1)) for n in [*below, len(points)]])
    # Intervals are half-open at the left in Bucketizer, here at the right: the signs turn.
    splits = [-float("inf"), *[-v for v in reversed(distinct)], float("inf")]
    turned = Bucketizer(splits=splits, inputCol="_turned", outputCol="_interval", handleInvalid="keep").transform(df.withColumn("_turned", -F.col(column).cast("double")))
    return turned.withColumn(into, F.when(F.col(column).isNotNull(), F.get(shares, (F.lit(len(distinct)) - F.col("_interval")).cast("int")))).drop("_turned", "_interval")


def bp_per_sd(coefficient: Column, deviation: Column) -> Column:
    return F.lit(10000.0) * coefficient * deviation
