"""Fitted models over the hourly bars."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.operators import bandit, features, models
from quern.paths import BASE_X, CROSS_X
from quern.plans import cleaning_queries, inputs
from quern.plans.bandit_queries import TOKENS
from quern.plans.feature_queries import CONTINUOUS, PATHS, one, two
from quern.plans.inputs import HOURLY, table

NUMERIC = ["imbalance", "log_range", "body", "ticks"]


def elastic_net_cv(spark, d):
    lo, hi = HOURLY.start_us, HOURLY.end_us - HOURLY.interval_us
    made = features.crosses(one(spark, d)).withColumns({c: F.col(c).cast("double") for c in BASE_X})
    made = features.time_blocks(made.na.drop(subset=["y", *BASE_X]), 5, lo, hi).persist()
    try:
        return models.elastic_net(made, models.select_varying(made, [*BASE_X, *CROSS_X]), "y")[0]
    finally:
        made.unpersist()


def variance_selector(spark, d):
    made = one(spark, d).where("is_missing_bar = 0").withColumns({"constant": F.lit(1.0), "n_ticks": F.col("n_ticks").cast("double")}).na.drop(subset=CONTINUOUS)
    kept = models.select_varying(made, [*CONTINUOUS, "n_ticks", "constant"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def median_imputer(spark, d):
    made = models.impute_medians(two(spark, d), NUMERIC[:3])
    return made.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in NUMERIC[:3]])


def fpgrowth_rules(spark, d):
    made = bandit.baskets(inputs.hourly(spark, d))
    rules = models.association_rules(made, ordered=False).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "confidence", "lift", "support")
    return rules.withColumns({c: F.round(c, 9) for c in ("confidence", "lift", "support")})


def token_l1_path(spark, d):
    made = bandit.baskets(inputs.hourly(spark, d))
    target = bandit.rewards(inputs.hourly(spark, d)).where("symbol = 'view' AND reward_strict IS NOT NULL").select("bar_us", F.col("reward_strict").cast("double").alias("label"))
    # The whole vocabulary: some declared states a symbol, and the hours.
    tokens = sorted(r["token"] for r in bandit.token_support(made).collect())
    return models.token_path(made, target, "bar_us", tokens, (0.001, 0.01, 0.03, 0.1, 0.3, 1.0))


def encoded_model_matrix(spark, d):
    made = models.encode(cleaning_queries.contacts(spark, d), ["c_mktsegment", "o_orderpriority"])
    out = models.model_matrix(made, ["o_totalprice", "c_acctbal"], ["o_orderkey", "c_mktsegment_idx", "c_mktsegment_vec", "o_orderpriority_idx", "o_orderpriority_vec"], "y")
    segment, priority, scaled = (vector_to_array(c) for c in ("c_mktsegment_vec", "o_orderpriority_vec", "features_std"))
    ones = lambda v: F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "")
    return out.select(
        "o_orderkey", F.col("c_mktsegment_idx").cast("int").alias("segment_idx"), F.col("o_orderpriority_idx").cast("int").alias("priority_idx"), ones(segment).alias("segment"), ones(priority).alias("priority"),
        F.round(F.get(scaled, 0), 8).alias("price_std"), F.round(F.get(scaled, 1), 8).alias("balance_std"), "y",
    )


def rarest_tokens(spark, d):
    return bandit.rarest(bandit.token_support(bandit.baskets(inputs.hourly(spark, d))), 5).withColumn("support", F.round("support", 9))


def strongest_correlation(spark, d):
    return models.strongest(features.correlation_long(one(spark, d), CONTINUOUS, digits=6), "r", 1)


#: Every set of tokens in a basket, the frequent ones, and the rules that split one token off.
RULES_SQL = f"""{TOKENS}, b AS (SELECT bar_us, list(token ORDER BY token) AS items FROM tokens GROUP BY 1), n AS (SELECT count(*) AS total FROM b),
sets AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM b, unnest(range(1, 1 << len(items))) AS u(m)),
often AS (SELECT s, count(*) AS c FROM sets GROUP BY 1 HAVING count(*) >= ceil((SELECT total FROM n) * 0.003::DOUBLE)),
split AS (SELECT s, c, unnest(s) AS token FROM often WHERE len(s) > 1)
SELECT array_to_string(a.s, ',') AS antecedent, token AS consequent, round(p.c / a.c, 9) AS confidence, round((p.c / a.c) / (o.c / total), 9) AS lift, round(p.c / total, 9) AS support
FROM split p JOIN often a ON a.s = list_filter(p.s, lambda x: x <> p.token) JOIN often o ON o.s = [p.token], n WHERE p.c / a.c >= 0.5"""


def _encoded_sql() -> str:
    rank = lambda c: f"(SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i, count(*) OVER () AS k FROM contacts GROUP BY 1)"
    ones = lambda t: f"repeat('0', CAST({t}.i AS INTEGER)) || '1' || repeat('0', CAST({t}.k - {t}.i - 1 AS INTEGER))"
    return (
        f"WITH {cleaning_queries.CONTACTS}, m AS (SELECT avg(o_totalprice) AS pm, stddev_samp(o_totalprice) AS ps, avg(c_acctbal) AS bm, stddev_samp(c_acctbal) AS bs FROM contacts) "
        f"SELECT o_orderkey, CAST(a.i AS INTEGER) AS segment_idx, CAST(b.i AS INTEGER) AS priority_idx, {ones('a')} AS segment, {ones('b')} AS priority, round((o_totalprice - pm) / ps, 8) AS price_std, round((c_acctbal - bm) / bs, 8) AS balance_std, y "
        f"FROM contacts JOIN {rank('c_mktsegment')} a ON a.v = c_mktsegment JOIN {rank('o_orderpriority')} b ON b.v = o_orderpriority, m"
    )


_DISCRETE_SQL = """WITH q AS (SELECT list_distinct(quantile_disc(value, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM events)
SELECT CAST(len(list_filter(cuts, lambda c: c <= value)) AS DOUBLE) AS bucket, count(*) AS n, min(value) AS lowest, max(value) AS highest FROM events, q GROUP BY 1"""
_VARYING = [*CONTINUOUS, "n_ticks", "constant"]
_VARIANCE_SQL = f"{PATHS}, f AS (SELECT *, 1.0 AS constant FROM p1 WHERE is_missing_bar = 0 AND " + " AND ".join(f"{c} IS NOT NULL" for c in CONTINUOUS) + ") " + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM f HAVING var_samp({c}) > 0" for c in _VARYING)
_FILLED = ", ".join(f"count(*) FILTER (WHERE coalesce({c}, (SELECT median({c}) FROM p2)) IS NULL) AS null_{c}" for c in NUMERIC[:3])


QUERIES = {
    "elastic_net_cv": (elastic_net_cv, None),
    "multinomial_cv": (lambda spark, d: models.multinomial(two(spark, d), NUMERIC), None),
    "scaling_search": (lambda spark, d: models.scaling_search(two(spark, d), NUMERIC), None),
    "variance_selector": (variance_selector, _VARIANCE_SQL),
    "median_imputer": (
        median_imputer,
        f"{PATHS} SELECT symbol, count(*) AS n, {_FILLED} FROM p2 GROUP BY 1",
    ),
    "fpgrowth_rules": (fpgrowth_rules, RULES_SQL),
    "rarest_tokens": (rarest_tokens, f"{TOKENS} SELECT token, count(*) AS n, round(count(*) / (SELECT count(DISTINCT bar_us) FROM tokens), 9) AS support FROM tokens GROUP BY 1 ORDER BY 2, 1 LIMIT 5"),
    "strongest_correlation": (
        strongest_correlation,
        f"{PATHS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM p1" for a, b in combinations(CONTINUOUS, 2)) + ") WHERE r IS NOT NULL ORDER BY abs(r) DESC, 1, 2 LIMIT 1",
    ),
    "token_l1_path": (token_l1_path, None),
    "encoded_model_matrix": (encoded_model_matrix, _encoded_sql()),
    "quantile_discretize": (
        lambda spark, d: models.discretise(table(spark, d, "events"), "value", 5, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")),
        _DISCRETE_SQL,
    ),
    "min_max_scale": (
        lambda spark, d: models.min_max(table(spark, d, "supplier"), ["s_acctbal"]).select("s_suppkey", F.round(F.get("scaled", 0), 9).alias("scaled")),
        "SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)), 9) AS scaled FROM supplier",
    ),
}
