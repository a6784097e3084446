"""The three refinery paths over dense bars, and the warehouse star with its policy evaluation.

Each path writes its artifacts under one folder and returns them.  The steps' verdicts are logged: what
applies, what a path replaces or forbids.  Numbers are measured on the run that logs them.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import bandit, bars, features, incremental, kpis, models
from quern.sources import tables
from quern.verdicts import BANDIT, CATEGORICAL, CONTINUOUS, firewall_fires, verdict

FOLDS = 5
#: The paths' numeric, crossed and categorical columns, in order.
BASE_X = [
    "open", "high", "low", "close", "volume", "quote_volume", "n_ticks", "taker_buy_qty", "taker_buy_quote_qty", "all_best_match", "is_missing_bar",
    "ret1", "range_bp", "body_bp", "imbalance", "log_qv",
]
CROSS_X = ["x_imb_ret", "x_range_qv", "x_imb_range", "x_ret_ticks"]
NUMERIC_X = [
    "imbalance", "log_range", "body", "ticks", "minute_sin", "minute_cos", "hour_sin", "hour_cos", "x_imb_body", "x_ticks_range", "x_imb_minute",
    "is_missing_bar", "is_first_bar", "is_last_bar",
]
CATEGORICAL_X = ["symbol", "best_match_state", "symbol_state"]
#: The columns of the arms' ledger, in order.
ARMS = [
    "symbol", "pulls", "observed", "budget_share", "alpha", "beta", "posterior_mean", "posterior_sd", "full_info_alpha", "full_info_beta", "full_info_rate",
    "share_mean", "share_sd", "share_min", "share_max", "won_final_argmax",
]


def _write(out: str, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    base = out.rstrip("/")
    for name, df in parts.items():
        tables.write_parquet(df, f"{base}/{name}")
    return {name: df.sparkSession.read.parquet(f"{base}/{name}") for name, df in parts.items()}


def continuous(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """Next-bar returns: firewall, density, topology, crosses, pruning, elastic net over time blocks, scaling."""
    loaded = bars.load_bars(spark, path)
    say = lambda *a, **k: verdict(*a, allowed=CONTINUOUS, **k)
    made = features.crosses(features.continuous(loaded.bars)).withColumns({c: F.col(c).cast("double") for c in BASE_X})
    anatomy = features.null_anatomy(made).first()
    rate = anatomy["missing"] / max(anatomy["n_rows"], 1)
    over = firewall_fires(rate)
    say(True, f"impute: {anatomy['missing']} of {anatomy['n_rows']} targets are missing; {'complete cases' if over else 'medians'}", override=over)
    lo, hi = loaded.bars.agg(F.min("bar_us"), F.max("bar_us")).first()
    kept = features.time_blocks(made.na.drop(subset=["y"]), FOLDS, lo, hi)
    # Derived columns have no median that would be a bar's: they need both ends.
    kept = kept.na.drop(subset=BASE_X) if over else models.impute_medians(kept, BASE_X)
    kept = features.crosses(kept).persist()
    try:
        columns = models.select_varying(kept, BASE_X + CROSS_X)
        say(len(columns) < len(BASE_X + CROSS_X), f"prune: {len(BASE_X + CROSS_X) - len(columns)} columns do not vary")
        say(False, "prune: strings take no part in this path", banned=True)
        ledger, _ = models.elastic_net(kept, columns, "y", "fold")
        winners = [r["feature"] for r in ledger.where("survived_step9").collect()] or columns
        say(True, f"scale: {len(winners)} columns, standard scaling only", limit=True)
        scaled = models.model_matrix(kept, winners, ["symbol", "bar_us", "fold"], "y").withColumn("_s", vector_to_array("features_std"))
        named = scaled.select("symbol", "bar_us", "fold", "y", *[F.get("_s", k).alias(f"{c}_scaled") for k, c in enumerate(winners)])
        return _write(out, {"features": named, "topology": features.correlation_long(kept, columns), "coefficients": ledger, "density": features.density(kept, "y")})
    finally:
        kept.unpersist()


def categorical(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """Next-bar direction: group medians, balance, topology by symbol, one-hot before pruning, classifier, scaling search."""
    loaded = bars.load_bars(spark, path)
    say = lambda *a, **k: verdict(*a, allowed=CATEGORICAL, **k)
    made = features.clock_features(features.categorical(loaded.bars), "bar_open_time_utc")
    made = features.fill_group_medians(made, "symbol", ["imbalance", "log_range", "body", "ticks"])
    made = features.categorical_crosses(features.fill_state(made, ["best_match_state"])).persist()
    try:
        say(True, f"encode: {len(CATEGORICAL_X)} columns become one-hot levels before any variance is taken", enforce=True)
        levels = {c: sorted(r[0] for r in made.select(c).distinct().collect() if r[0] is not None) for c in CATEGORICAL_X}
        wide = made
        for c, values in levels.items():
            wide = features.one_hot(wide, c, values)
        names = NUMERIC_X + [f"oh__{c}__{v}" for c, values in levels.items() for v in values]
        columns = models.select_varying(wide.na.drop(subset=NUMERIC_X), names)
        say(len(columns) < len(names), f"prune: {len(names) - len(columns)} columns do not vary")
        grid = models.multinomial(wide, columns)
        best = grid.orderBy(F.desc("cv_time_ordered"), "reg_param", "elastic_net").first()
        weights = models.multinomial_coefficients(wide, columns, best["reg_param"], best["elastic_net"], best["majority"])
        search = models.scaling_search(wide, [c for c in NUMERIC_X if c in columns])
        known = wide.withColumn("label", models.label()).where(F.col("label").isNotNull())
        scaled = models.model_matrix(known, columns, ["symbol", "bar_us"], "y_class").withColumn("_s", vector_to_array("features_std"))
        named = scaled.select("symbol", "bar_us", "y_class", *[F.get("_s", k).alias(f"{c}_scaled") for k, c in enumerate(columns)])
        numeric = [c for c in NUMERIC_X if c in columns]
        pooled = features.correlation_long(made, numeric).select(F.lit("pooled").alias("grouping"), "column_a", "column_b", "r")
        grouped = features.correlation_long(made, numeric, "symbol").withColumnRenamed("symbol", "grouping")
        return _write(out, {"features": named, "topology": pooled.unionByName(grouped), "classifier": grid, "coefficients": weights, "scaling_search": search, "balance": features.class_balance(made)})
    finally:
        made.unpersist()


def arms_ledger(runs: DataFrame, rewarded: DataFrame, replicates: int) -> DataFrame:
    """``ARMS``: the first replay's counts, the full-information posterior, and the replicates' summary, a row an arm."""
    one = runs.where("replicate = 0").select(
        F.col("arm").alias("symbol"), "pulls", "observed", F.col("share").alias("budget_share"), "alpha", "beta", "posterior_mean", bandit.posterior_sd(F.col("alpha"), F.col("beta")).alias("posterior_sd")
    )
    full = bandit.posterior(rewarded, "symbol", "reward_strict").select("symbol", F.col("alpha").alias("full_info_alpha"), F.col("beta").alias("full_info_beta"), F.col("posterior_mean").alias("full_info_rate"))
    over = bandit.replay_summary(runs).select(F.col("arm").alias("symbol"), "share_mean", "share_sd", "share_min", "share_max", (F.col("ended_best") / F.lit(float(replicates))).alias("won_final_argmax"))
    return one.join(full, "symbol").join(over, "symbol").select(*ARMS)


def online(spark: SparkSession, path: str, out: str, replicates: int = 200, seed: int = 20250101) -> dict[str, DataFrame]:
    """The bandit path: nothing is filled, baskets of raw tokens, replays over seeds, full-information posterior."""
    loaded = bars.load_bars(spark, path)
    say = lambda *a, **k: verdict(*a, allowed=BANDIT, **k)
    empty = loaded.bars.agg(F.sum("is_missing_bar")).first()[0]
    say(empty > 0, f"impute: {empty} empty bars stay unobserved", override=True)
    made = features.clock_features(bandit.rewards(loaded.bars), "bar_open_time_utc").persist()
    try:
        sets = bandit.baskets(loaded.bars).persist()
        if sets.count() != loaded.slots:
            raise ValueError("some slot made no basket")
        for step in ("prune", "regularise", "scale"):
            say(False, f"{step}: tokens and counts are kept as they are", banned=True)
        # A few rows a replicate, read three times.
        runs = bandit.replays(made, loaded.symbols, replicates, seed).persist()
        arms = arms_ledger(runs, made, replicates)
        directions = kpis.pivot_count(made.where("direction IS NOT NULL"), "symbol", "direction", ["UP", "FLAT", "DOWN"])
        support = bandit.token_support(sets).persist()
        say(True, f"the rarest tokens: {[(r['token'], r['n']) for r in bandit.rarest(support).collect()]}")
        parts = _write(out, {"features": made, "frame": sets, "support": support, "directions": directions, "arms": arms})
        for held in (sets, support, runs):
            held.unpersist()
        return parts
    finally:
        made.unpersist()


#: The declared rate cuts of each risk band.
MAIL_CUTS = {"HIGH": (5.50, 7.50, 9.00, 10.00, 11.00), "MEDIUM": (5.00, 6.75, 7.50, 8.25, 9.25), "LOW": (4.50, 5.50, 6.00, 6.75, 7.50)}
MAIL_GRID = bandit.ArmGrid(MAIL_CUTS)


def star(spark: SparkSession, warehouse: str, offers: DataFrame, clients: DataFrame, grid: bandit.ArmGrid, state: incremental.StateStore, seed: int = 20031001, draws: int = 200_000, replicates: int = 2_000, run_id: str | None = None) -> dict[str, int]:
    """One incremental round: extract past the watermark, merge the raw zone, stage and merge the star, evaluate.

    ``offers`` has client_id, wave, rate, took_up; ``clients`` has client_id and risk_band.  The extract is staged
    (the stage is emptied before and after), both sources are checked before either is merged, the arms' dimension is
    seeded once and its rows counted each time, data are written before the watermark moves, and the fact's
    staging is checked before it is merged.  Tables by wave are merged by partition.
    """
    base = warehouse.rstrip("/")
    row = state.get("mail_offers")
    stage = f"{base}/stage_mail_offers"
    tables.write_parquet(incremental.extract(offers, row["load_column"], row["last_extracted_value"]), stage)
    got = spark.read.parquet(stage)
    n = got.count()
    mark = incremental.guarded_watermark(got, row["load_column"], row["last_extracted_value"])
    incremental.assert_unique(got, ["client_id", "wave"])
    incremental.assert_unique(clients, ["client_id"])
    dimension = grid.dimension(spark)
    tops = {f"risk_band = '{b}' AND rate_ceil IS NULL": 1 for b in grid.cuts}
    incremental.seed(dimension, f"{base}/dim_offer_arm", len(grid.rows()), {f"risk_band = '{b}'": len(c) + 1 for b, c in grid.cuts.items()} | tops)
    incremental.merge_partitions(spark, f"{base}/mail_offers", got, ["client_id", "wave"], "wave")
    incremental.upsert_through_stage(clients, f"{base}/client_attributes", ["client_id"])
    state.set("mail_offers", mark)
    tables.write_parquet(got.limit(0), f"{stage}.empty")
    incremental.swap_in(spark.read.parquet(f"{stage}.empty"), stage)

    spine = spark.read.parquet(f"{base}/mail_offers")
    attributes = incremental.current(spark, f"{base}/client_attributes")
    incremental.upsert_through_stage(attributes, f"{base}/dim_client", ["client_id"])
    facts_path = f"{base}/fact_mailer"
    there = tables.present(spark, [facts_path])[facts_path]
    source = incremental.newest_window(spine, spark.read.parquet(facts_path), "wave") if there else spine
    joined = source.join(spark.read.parquet(f"{base}/dim_client").select("client_id", F.col("risk_band").alias("band")), "client_id")
    staged = grid.join(joined, "band", "rate").withColumnRenamed("band", "risk_band").select("client_id", "wave", "risk_band", "rate", "took_up", "arm_id", "arm_index").persist()
    counts = staged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("arm_id").isNull()).alias("armless")).first()
    if counts["n"] != source.count() or counts["armless"]:
        raise ValueError(f"staged {counts['n']} rows, {counts['armless']} without an arm: nothing was merged; most repeated: {incremental.offenders(staged, ['client_id', 'wave']).collect()}")
    incremental.merge_partitions(spark, facts_path, staged, ["client_id", "wave"], "wave")
    staged.unpersist()

    every = bandit.full_cells(bandit.cells(spark.read.parquet(facts_path)), grid)
    beliefs, values = bandit.evaluate(every, grid, seed, draws, replicates)
    run_id = incremental.run_name(run_id or f"through-wave-{max(b['through_wave'] for b in beliefs)}")
    for name, rows in (("bandit_posterior", beliefs), ("bandit_policy_value", values)):
        if rows:
            incremental.replace_run_into(spark.createDataFrame([{**r, "run_id": run_id} for r in rows]), f"{base}/{name}")
    return {"extracted": n, "arms": len(grid.rows()), "clients": spark.read.parquet(f"{base}/dim_client").count(), "facts": spark.read.parquet(facts_path).count(), "posterior_rows": len(beliefs), "policy_rows": len(values)}
