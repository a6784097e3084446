"""Targets, features and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bars, features
from quern.plans import inputs
from quern.plans.inputs import DENSE, HOURLY, SYMBOLS

LEVELS = [str(k) for k in range(5)]
CONTINUOUS = ["ret1", "range_bp", "body_bp", "imbalance", "log_qv"]

#: Continuous and categorical features over the dense bars.
PATHS = DENSE + """, prev AS (
  SELECT *, lag(close) OVER w AS close_before, lead(close) OVER w AS close_after FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY bar_us)),
p1 AS (
  SELECT *, ln(CAST(close_after AS DOUBLE) / close) AS y, ln(CAST(close AS DOUBLE) / close_before) AS ret1, (high - low) / close * 10000 AS range_bp, (close - open) / close * 10000 AS body_bp,
    taker_buy_quote_qty / quote_volume AS imbalance, ln(CAST(quote_volume AS DOUBLE)) AS log_qv FROM prev),
p2 AS (
  SELECT *, CASE WHEN close_after > close THEN 'up' WHEN close_after < close THEN 'down' WHEN close_after = close THEN 'flat' END AS y_class, (2 * taker_buy_qty - volume) / volume AS imbalance,
    ln(CAST(high AS DOUBLE) / low) AS log_range, (close - open) / open AS body, CAST(n_ticks AS DOUBLE) AS ticks, CAST(all_best_match AS VARCHAR) AS best_match_state FROM prev)"""


def one(spark, d):
    return features.continuous(inputs.hourly(spark, d))


def two(spark, d):
    return features.categorical(inputs.hourly(spark, d))


def rounded(df, keys, columns, digits=8):
    return df.select(*keys, *[F.round(F.col(c), digits).alias(c) for c in columns])


def _round_sql(columns, digits=8):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def target_missing_firewall(spark, d):
    made = features.null_anatomy(one(spark, d))
    rate = F.round(F.col("missing") / F.col("n_rows"), 9)
    return made.withColumns({"missing_rate": rate, "fires": rate > 0.05})


def complete_case(spark, d):
    kept = one(spark, d).na.drop(subset=["y"]).na.drop(subset=CONTINUOUS)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("mean_y"))


def group_median_impute(spark, d):
    made = features.fill_group_medians(two(spark, d), "symbol", ["imbalance", "log_range", "body"])
    return rounded(made, ["symbol", "bar_us"], ["imbalance", "log_range", "body"])


def unknown_category(spark, d):
    return features.fill_state(two(spark, d), ["best_match_state"]).groupBy("symbol", "best_match_state").agg(F.count(F.lit(1)).alias("n"))


def density_profile(spark, d):
    return rounded(features.density(one(spark, d), "ret1"), ["n"], ["mean", "sd", "skewness", "kurtosis", "p01", "p25", "p50", "p75", "p99"], 6)


def class_balance(spark, d):
    return rounded(features.class_balance(two(spark, d)), ["y_class", "n"], ["share"], 9)


def pearson_matrix_long(spark, d):
    return features.correlation_long(one(spark, d), CONTINUOUS, digits=6)


def pearson_by_group(spark, d):
    return features.correlation_long(one(spark, d), CONTINUOUS, "symbol", 6)


def correlation_sign_flips(spark, d):
    made = one(spark, d)
    return features.sign_flips(features.correlation_long(made, CONTINUOUS), features.correlation_long(made, CONTINUOUS, "symbol"))


_PAIRS = [(a, b) for k, a in enumerate(CONTINUOUS) for b in CONTINUOUS[k + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM p1" for a, b in _PAIRS)
_CORR_BY = " UNION ALL ".join(f"SELECT symbol, '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM p1 GROUP BY symbol" for a, b in _PAIRS)


def cyclical_encode(spark, d):
    made = features.clock_features(inputs.table(spark, d, "events"), "ts")
    return rounded(made, ["event_id"], ["minute_sin", "minute_cos", "hour_sin", "hour_cos"], 9)


def cross_products(spark, d):
    return rounded(features.crosses(one(spark, d)), ["symbol", "bar_us"], ["x_imb_ret", "x_range_qv", "x_imb_range", "x_ret_ticks"], 6)


def categorical_cross(spark, d):
    made = features.categorical_crosses(features.clock_features(two(spark, d), "bar_open_time_utc"))
    return made.select("symbol", "bar_us", "symbol_state", F.round("x_imb_body", 7).alias("x_imb_body"), F.round("x_ticks_range", 6).alias("x_ticks_range"))


def onehot_levels(spark, d):
    made = features.one_hot(inputs.hourly(spark, d), "symbol", SYMBOLS)
    return made.groupBy("is_missing_bar").agg(*[F.sum(f"oh__symbol__{s}").alias(f"n_{s}") for s in SYMBOLS])


def variance_by_level(spark, d):
    return rounded(features.level_variances(inputs.hourly(spark, d).where("is_missing_bar = 0"), "symbol", SYMBOLS), ["level"], ["variance"], 9)


def index_code_variance(spark, d):
    return rounded(features.index_code_variance(inputs.table(spark, d, "events"), "event_type"), [], ["by_frequency", "by_alphabet"], 8)


def time_block_folds(spark, d):
    lo, hi = HOURLY.start_us, HOURLY.end_us - HOURLY.interval_us
    return features.time_blocks(inputs.hourly(spark, d), 5, lo, hi).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("bar_us").alias("first_us"), F.max("bar_us").alias("last_us"))


def standard_scale(spark, d):
    made = one(spark, d).where("is_missing_bar = 0")
    return rounded(features.standard_scale(made, ["range_bp", "log_qv"]), ["symbol", "bar_us"], ["range_bp_std", "log_qv_std"], 6)


def signed_log1p(spark, d):
    return one(spark, d).select("symbol", "bar_us", F.round(features.signed_log1p(F.col("body_bp")), 7).alias("body_log"))


def percent_rank_scale(spark, d):
    made = one(spark, d).select("symbol", "bar_us", "n_ticks")
    return rounded(features.rank_scale(made, "n_ticks", "ticks_rank", "symbol"), ["symbol", "bar_us"], ["ticks_rank"], 9)


_LO, _HI = HOURLY.start_us, HOURLY.end_us - HOURLY.interval_us
_WIDTH = (_HI - _LO + 1) / 5
QUERIES = {
    "next_return_target": (
        lambda spark, d: rounded(one(spark, d), ["symbol", "bar_us"], ["y", *CONTINUOUS], 7),
        f"{PATHS} SELECT symbol, bar_us, {_round_sql(['y', *CONTINUOUS], 7)} FROM p1",
    ),
    "target_missing_firewall": (
        target_missing_firewall,
        f"{PATHS}, a AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE y IS NULL) AS missing, count(*) FILTER (WHERE y IS NULL AND is_missing_bar = 1) AS own_bar_empty, count(*) FILTER (WHERE y IS NULL AND is_last_bar = 1 AND is_missing_bar = 0) AS end_of_calendar, count(*) FILTER (WHERE y IS NULL AND is_last_bar = 0 AND is_missing_bar = 0) AS next_bar_empty FROM p1) "
        "SELECT *, round(missing / n_rows, 9) AS missing_rate, round(missing / n_rows, 9) > 0.05 AS fires FROM a",
    ),
    "complete_case": (
        complete_case,
        f"{PATHS} SELECT symbol, count(*) AS n, round(avg(y), 8) AS mean_y FROM p1 WHERE y IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in CONTINUOUS) + " GROUP BY 1",
    ),
    "group_median_impute": (
        group_median_impute,
        f"{PATHS}, m AS (SELECT symbol, median(imbalance) AS a, median(log_range) AS b, median(body) AS c FROM p2 GROUP BY 1) SELECT p2.symbol, bar_us, round(coalesce(imbalance, a), 8) AS imbalance, round(coalesce(log_range, b), 8) AS log_range, round(coalesce(body, c), 8) AS body FROM p2 LEFT JOIN m ON m.symbol = p2.symbol",
    ),
    "unknown_category": (unknown_category, f"{PATHS} SELECT symbol, coalesce(best_match_state, 'SYSTEM_STATE_UNKNOWN') AS best_match_state, count(*) AS n FROM p2 GROUP BY 1, 2"),
    "density_profile": (
        density_profile,
        f"{PATHS}, v AS (SELECT ret1 AS x FROM p1 WHERE ret1 IS NOT NULL), m AS (SELECT avg(x) AS mu FROM v), s AS (SELECT avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4 FROM v, m) "
        "SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(any_value(m3) / any_value(m2) ** 1.5, 6) AS skewness, round(any_value(m4) / any_value(m2) ** 2 - 3, 6) AS kurtosis, "
        + ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{n}" for n, p in (("01", 0.01), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("99", 0.99)))
        + " FROM v, s",
    ),
    "class_balance": (class_balance, f"{PATHS} SELECT y_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM p2 WHERE y_class IS NOT NULL GROUP BY 1"),
    "pearson_matrix_long": (pearson_matrix_long, f"{PATHS} {_CORR}"),
    "pearson_by_group": (pearson_by_group, f"{PATHS} {_CORR_BY}"),
    "correlation_sign_flips": (
        correlation_sign_flips,
        f"{PATHS}, pooled AS ({_CORR.replace(', 6)', ', 12)')}), grouped AS ({_CORR_BY.replace(', 6)', ', 12)')}) SELECT count(*) AS cells, count(*) FILTER (WHERE sign(g.r) * sign(p.r) < 0) AS flips, count(*) FILTER (WHERE g.r IS NULL) AS undefined FROM grouped g JOIN pooled p USING (column_a, column_b)",
    ),
    "cyclical_encode": (
        cyclical_encode,
        "SELECT event_id, round(sin(2 * pi() * minute(ts) / 60), 9) AS minute_sin, round(cos(2 * pi() * minute(ts) / 60), 9) AS minute_cos, round(sin(2 * pi() * hour(ts) / 24), 9) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) AS hour_cos FROM events",
    ),
    "cross_products": (
        cross_products,
        f"{PATHS} SELECT symbol, bar_us, round(imbalance * ret1, 6) AS x_imb_ret, round(range_bp * log_qv, 6) AS x_range_qv, round(imbalance * range_bp, 6) AS x_imb_range, round(ret1 * n_ticks, 6) AS x_ret_ticks FROM p1",
    ),
    "categorical_cross": (
        categorical_cross,
        f"{PATHS} SELECT symbol, bar_us, concat_ws('__', symbol, best_match_state) AS symbol_state, round(imbalance * body, 7) AS x_imb_body, round(ticks * log_range, 6) AS x_ticks_range FROM p2",
    ),
    "onehot_levels": (onehot_levels, f"{DENSE} SELECT is_missing_bar, " + ", ".join(f"CAST(count(*) FILTER (WHERE symbol = '{s}') AS DOUBLE) AS n_{s}" for s in SYMBOLS) + " FROM dense GROUP BY 1"),
    "variance_by_level": (variance_by_level, f"{DENSE} " + " UNION ALL ".join(f"SELECT '{s}' AS level, round(var_samp(CASE WHEN symbol = '{s}' THEN 1.0 ELSE 0.0 END), 9) AS variance FROM dense WHERE is_missing_bar = 0" for s in SYMBOLS)),
    "index_code_variance": (
        index_code_variance,
        "WITH c AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS f, row_number() OVER (ORDER BY event_type) - 1 AS a FROM events GROUP BY 1) SELECT round(var_samp(f), 8) AS by_frequency, round(var_samp(a), 8) AS by_alphabet FROM events e JOIN c ON c.event_type = e.event_type",
    ),
    "time_block_folds": (
        time_block_folds,
        f"{DENSE} SELECT CAST(least(4, floor((bar_us - {_LO}) / {_WIDTH!r}::DOUBLE)) AS INTEGER) AS fold, count(*) AS n, min(bar_us) AS first_us, max(bar_us) AS last_us FROM dense GROUP BY 1",
    ),
    "standard_scale": (
        standard_scale,
        f"{PATHS}, f AS (SELECT * FROM p1 WHERE is_missing_bar = 0), m AS (SELECT avg(range_bp) AS a, stddev_samp(range_bp) AS b, avg(log_qv) AS c, stddev_samp(log_qv) AS e FROM f) SELECT symbol, bar_us, round((range_bp - a) / b, 6) AS range_bp_std, round((log_qv - c) / e, 6) AS log_qv_std FROM f, m",
    ),
    "signed_log1p": (signed_log1p, f"{PATHS} SELECT symbol, bar_us, round(sign(body_bp) * ln(1 + abs(body_bp)), 7) AS body_log FROM p1"),
    "percent_rank_scale": (percent_rank_scale, f"{DENSE} SELECT symbol, bar_us, round(percent_rank() OVER (PARTITION BY symbol ORDER BY n_ticks NULLS FIRST), 9) AS ticks_rank FROM dense"),
}
