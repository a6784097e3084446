"""Streaming forms of the batch operators (an extension: the batch pipelines have no stream).

Bars close once the watermark passes their end, so appended bars are final.  The bandit keeps each arm's
discounted counts as keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.bandit import DISCOUNT, PRIOR
from quern.operators.bars import TOTAL


def streaming_bars(ticks: DataFrame, interval: str, lateness: str, time: str = "event_time") -> DataFrame:
    """Tumbling event-time bars of a stream of ticks (symbol, trade_id, price, qty, ``time``)."""
    return (
        ticks.withWatermark(time, lateness)
        .groupBy(F.window(time, interval), "symbol")
        .agg(F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"), F.sum("qty").cast(TOTAL).alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
        .select("symbol", F.col("window.start").alias("bar_open_time_utc"), "open", "high", "low", "close", "volume", "n_ticks")
    )


def streaming_posterior(rewards: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Discounted Beta counts of each arm over a stream of (arm, reward, order); a NULL reward only decays them."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, beta, pulls = state.get if state.exists else (*PRIOR, 0)
        rows = pd.concat(list(batches)).sort_values("order")
        for reward in rows["reward"]:
            alpha, beta, pulls = alpha * discount, beta * discount, pulls + 1
            if pd.notna(reward):
                alpha, beta = alpha + float(reward), beta + 1.0 - float(reward)
        state.update((alpha, beta, pulls))
        yield pd.DataFrame({"arm": [key[0]], "alpha": [alpha], "beta": [beta], "pulls": [pulls]})

    return rewards.groupBy("arm").applyInPandasWithState(update, "arm string, alpha double, beta double, pulls long", "alpha double, beta double, pulls long", "update", GroupStateTimeout.NoTimeout)
