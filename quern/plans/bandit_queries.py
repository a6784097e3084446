"""Rewards, baskets, arms, posteriors and policy values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bandit, kpis
from quern.plans import inputs
from quern.plans.inputs import CELLS, DENSE, FACTS, GRID, SYMBOLS

REWARDS = DENSE + """, lagged AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_us) AS before FROM dense), rewarded AS (
  SELECT *, CASE WHEN close > before THEN 1 WHEN close <= before THEN 0 END AS reward_strict, CASE WHEN close >= before THEN 1 WHEN close < before THEN 0 END AS reward_loose,
    CASE WHEN close > before THEN 'UP' WHEN close < before THEN 'DOWN' WHEN close = before THEN 'FLAT' END AS direction, taker_buy_qty / volume AS share FROM lagged)"""
TOKENS = REWARDS + """, tokens AS (
  SELECT bar_us, symbol || '_NO_TRADES' AS token FROM rewarded WHERE is_missing_bar = 1
  UNION SELECT bar_us, symbol || '_' || CASE WHEN share >= 0.90 THEN 'TAKER_EXTREME' WHEN share >= 0.60 THEN 'TAKER_HEAVY' WHEN share >= 0.40 THEN 'BALANCED' WHEN share >= 0.10 THEN 'MAKER_HEAVY' ELSE 'MAKER_EXTREME' END FROM rewarded WHERE share IS NOT NULL
  UNION SELECT bar_us, symbol || '_DIR_' || direction FROM rewarded WHERE direction IS NOT NULL
  UNION SELECT bar_us, symbol || '_NOT_BEST_MATCH' FROM rewarded WHERE NOT all_best_match
  UNION SELECT bar_us, 'HOUR_' || lpad(CAST(hour(bar_open_time_utc) AS VARCHAR), 2, '0') FROM rewarded)"""
_BELIEF = "pulls, rewards, CAST(1 + rewards AS DOUBLE) AS alpha, CAST(1 + pulls - rewards AS DOUBLE) AS beta, round((1 + rewards) / (2 + pulls), 8) AS posterior_mean, round(sqrt(CAST(1 + rewards AS DOUBLE) * (1 + pulls - rewards) / (CAST(2 + pulls AS DOUBLE) * (2 + pulls) * (3 + pulls))), 8) AS posterior_sd"


def rewarded(spark, d):
    return bandit.rewards(inputs.hourly(spark, d))


def every(spark, d):
    return bandit.full_cells(bandit.cells(inputs.facts(spark, d)), GRID)


def beliefs(spark, d):
    made = bandit.posterior_by_wave(every(spark, d))
    return made.withColumns({"posterior_mean": F.round("posterior_mean", 8), "posterior_sd": F.round("posterior_sd", 8)})


def direction_pivot(spark, d):
    made = kpis.pivot_count(rewarded(spark, d).where("direction IS NOT NULL"), "symbol", "direction", ["UP", "FLAT", "DOWN", "HALT"])
    return made.select("symbol", *[F.col(c).alias(f"n_{c.lower()}") for c in ("UP", "FLAT", "DOWN", "HALT")])


def stream_diagnostics(spark, d):
    made = bandit.stream_diagnostics(inputs.hourly(spark, d))
    return made.withColumns({"strict_rate": F.round("strict_rate", 9), "loose_rate": F.round("loose_rate", 9)})


def token_baskets(spark, d):
    return bandit.baskets(inputs.hourly(spark, d)).select("bar_us", F.array_join("items", ",").alias("items"), F.size("items").cast("bigint").alias("n_items"))


def token_support(spark, d):
    return bandit.token_support(bandit.baskets(inputs.hourly(spark, d))).withColumn("support", F.round("support", 9))


def full_info_posterior(spark, d):
    made = bandit.posterior(rewarded(spark, d), "symbol", "reward_strict")
    return made.withColumns({"posterior_mean": F.round("posterior_mean", 8), "posterior_sd": F.round("posterior_sd", 8)})


def arm_bisect(spark, d):
    made = inputs.facts(spark, d).withColumn("counted", GRID.index("risk_band", F.col("rate")))
    return made.groupBy("risk_band", "counted").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("counted") != F.col("arm_index")).alias("disagree"))


def snips_value(spark, d):
    """The value of playing arms in proportion to their posterior means through the wave before."""
    before = bandit.posterior_by_wave(every(spark, d)).select((F.col("through_wave") + 1).alias("wave"), "arm_id", F.col("posterior_mean").alias("pi"))
    made = bandit.snips(every(spark, d).join(before, ["wave", "arm_id"]), ["wave", "risk_band"])
    return made.withColumns({c: F.round(c, 9) for c in ("logging_value", "snips_value")})


def null_flags_by_wave(spark, d):
    made = inputs.facts(spark, d).select("wave", F.when(F.col("wave") > 1, F.col("took_up")).alias("flag_a"), F.when(F.col("rate") > 100000, F.col("took_up")).alias("flag_b"))
    return made.groupBy("wave").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("flag_a", "flag_b")])


def boolean_from_int(spark, d):
    made = inputs.facts(spark, d).select(F.when(F.col("wave") > 1, F.col("took_up")).alias("flag")).select((F.col("flag") == 1).alias("flag"))
    return made.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def exposure(spark, d):
    """Positivity: the smallest cell and the arms without a pull, by wave and band."""
    return every(spark, d).groupBy("wave", "risk_band").agg(F.min("pulls").alias("smallest_cell"), F.count_if(F.col("pulls") == 0).alias("unexposed_arms"), F.sum("pulls").alias("n_rows"))


QUERIES = {
    "reward_strict_loose": (
        lambda spark, d: rewarded(spark, d).select("symbol", "bar_us", "reward_strict", "reward_loose", "direction"),
        f"{REWARDS} SELECT symbol, bar_us, reward_strict, reward_loose, direction FROM rewarded",
    ),
    "direction_pivot": (
        direction_pivot,
        f"{REWARDS} SELECT symbol, " + ", ".join(f"count(*) FILTER (WHERE direction = '{c}') AS n_{c.lower()}" for c in ("UP", "FLAT", "DOWN", "HALT")) + " FROM rewarded WHERE direction IS NOT NULL GROUP BY 1",
    ),
    "stream_diagnostics": (
        stream_diagnostics,
        f"{REWARDS} SELECT symbol, count(*) AS slots, count(reward_strict) AS observed, count(*) - count(reward_strict) AS unobserved, round(avg(reward_strict), 9) AS strict_rate, round(avg(reward_loose), 9) AS loose_rate, median(n_ticks) AS median_ticks FROM rewarded GROUP BY 1",
    ),
    "token_baskets": (token_baskets, f"{TOKENS} SELECT bar_us, string_agg(token, ',' ORDER BY token) AS items, count(*) AS n_items FROM tokens GROUP BY 1"),
    "token_support": (token_support, f"{TOKENS} SELECT token, count(*) AS n, round(count(*) / (SELECT count(DISTINCT bar_us) FROM tokens), 9) AS support FROM tokens GROUP BY 1"),
    "full_info_posterior": (
        full_info_posterior,
        f"{REWARDS}, c AS (SELECT symbol, count(*) FILTER (WHERE reward_strict = 1) AS wins, count(*) FILTER (WHERE reward_strict = 0) AS losses, count(*) FILTER (WHERE reward_strict IS NULL) AS unobserved FROM rewarded GROUP BY 1) "
        "SELECT symbol, wins, losses, unobserved, CAST(wins + 1 AS DOUBLE) AS alpha, CAST(losses + 1 AS DOUBLE) AS beta, round((wins + 1) / (wins + losses + 2), 8) AS posterior_mean, round(sqrt(CAST(wins + 1 AS DOUBLE) * (losses + 1) / (CAST(wins + losses + 2 AS DOUBLE) * (wins + losses + 2) * (wins + losses + 3))), 8) AS posterior_sd FROM c",
    ),
    "arm_band_join": (
        lambda spark, d: inputs.facts(spark, d).select("offer_id", "wave", "risk_band", "rate", "took_up", "arm_id", "arm_index"),
        f"WITH {FACTS} SELECT offer_id, wave, risk_band, rate, took_up, arm_id, arm_index FROM facts",
    ),
    "arm_bisect": (arm_bisect, f"WITH {FACTS}, c AS (SELECT risk_band, arm_index, (SELECT count(*) FROM arms a WHERE a.risk_band = f.risk_band AND a.rate_floor <= f.rate) AS counted FROM facts f) SELECT risk_band, CAST(counted AS INTEGER) AS counted, count(*) AS n, count(*) FILTER (WHERE counted <> arm_index) AS disagree FROM c GROUP BY 1, 2"),
    "wave_arm_cells": (lambda spark, d: bandit.cells(inputs.facts(spark, d)), f"WITH {CELLS} SELECT wave, risk_band, arm_id, arm_index, pulls, rewards, min_rate, max_rate FROM cells"),
    "posterior_by_wave": (beliefs, f"WITH {CELLS} SELECT through_wave, arm_id, risk_band, arm_index, {_BELIEF} FROM belief"),
    "snips_value": (
        snips_value,
        f"WITH {CELLS}, pi AS (SELECT through_wave + 1 AS wave, arm_id, (1 + rewards) / (2 + pulls) AS pi FROM belief) SELECT e.wave, e.risk_band, CAST(sum(pulls) AS BIGINT) AS n_rows, round(sum(rewards) / sum(pulls), 9) AS logging_value, round(sum(CASE WHEN pulls > 0 THEN pi * (rewards / pulls) END) / sum(CASE WHEN pulls > 0 THEN pi END), 9) AS snips_value FROM every e JOIN pi ON pi.wave = e.wave AND pi.arm_id = e.arm_id GROUP BY 1, 2",
    ),
    "exposure_positivity": (exposure, f"WITH {CELLS} SELECT wave, risk_band, min(pulls) AS smallest_cell, count(*) FILTER (WHERE pulls = 0) AS unexposed_arms, CAST(sum(pulls) AS BIGINT) AS n_rows FROM every GROUP BY 1, 2"),
    "null_flags_by_wave": (
        null_flags_by_wave,
        f"WITH {FACTS} SELECT wave, count(*) AS n, count(*) FILTER (WHERE wave = 1) AS null_flag_a, count(*) FILTER (WHERE NOT rate > 100000) AS null_flag_b FROM facts GROUP BY 1",
    ),
    "boolean_from_int": (boolean_from_int, f"WITH {FACTS} SELECT CASE WHEN wave > 1 THEN took_up = 1 END AS flag, count(*) AS n FROM facts GROUP BY 1"),
    "thompson_replay": (lambda spark, d: bandit.replays(rewarded(spark, d), SYMBOLS), None),
    "thompson_replay_summary": (lambda spark, d: bandit.replay_summary(bandit.replays(rewarded(spark, d), SYMBOLS)), None),
    "thompson_policy": (lambda spark, d: spark.createDataFrame(bandit.evaluate(every(spark, d), GRID)[0]), None),
    "bootstrap_ci": (lambda spark, d: spark.createDataFrame(bandit.evaluate(every(spark, d), GRID)[1]), None),
}
