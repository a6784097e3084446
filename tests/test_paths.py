"""The refinery paths and the star, end to end on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern import paths
from quern.operators import bandit, bars, incremental


@pytest.fixture(scope="module")
def bar_table(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, price = [], {"A": 10.0, "B": 20.0}
    for i in range(3000):
        s = "AB"[i % 2]
        price[s] = max(1.0, price[s] + rng.choice([-0.5, 0.0, 0.5]))
        rows.append((i, price[s], float(1 + rng.randrange(5)), i * 1_000_000, rng.random() < 0.5, rng.random() < 0.98, s))
    df = spark.createDataFrame(rows, "trade_id long, p double, q double, event_time_us long, is_buyer_maker boolean, is_best_match boolean, symbol string")
    ticks = df.selectExpr("trade_id", "CAST(p AS DECIMAL(18,8)) price", "CAST(q AS DECIMAL(18,8)) qty", "CAST(p * q AS DECIMAL(18,8)) quote_qty", "event_time_us", "is_buyer_maker", "is_best_match", "symbol")
    path = str(tmp_path_factory.mktemp("bars") / "t")
    bars.dense_bars(ticks.where("NOT event_time_us BETWEEN 500000000 AND 520000000"), bars.Calendar(0, 3000 * bars.SECOND, 10 * bars.SECOND), ["A", "B"]).write.parquet(path)
    return path


def test_continuous_path(spark, bar_table, tmp_path):
    made = paths.continuous(spark, bar_table, str(tmp_path))
    assert made["coefficients"].count() > 5 and made["features"].count() > 500 and "bp_per_sd" in made["coefficients"].columns


def test_bandit_path(spark, bar_table, tmp_path):
    made = paths.online(spark, bar_table, str(tmp_path), replicates=8)
    assert made["frame"].count() == 300 and made["arms"].count() == 2
    assert abs(made["arms"].agg(F.sum("won_final_argmax")).first()[0] - 1) < 1e-9 and made["arms"].columns == paths.ARMS and abs(made["arms"].agg(F.sum("share_mean")).first()[0] - 1) < 1e-9


def test_categorical_path(spark, bar_table, tmp_path):
    made = paths.categorical(spark, bar_table, str(tmp_path))
    assert made["classifier"].count() == 4 and made["scaling_search"].count() == 3 and made["balance"].count() == 3


def test_star_in_four_runs(spark, tmp_path):
    rng = random.Random(2)
    offers = spark.createDataFrame([(i, 1 + i % 3, 3.0 + (i * 7 % 80) / 10, rng.randrange(2)) for i in range(900)], "client_id long, wave int, rate double, took_up int")
    clients = spark.createDataFrame([(i, ["HIGH", "LOW"][i % 2]) for i in range(900)], "client_id long, risk_band string")
    grid = bandit.ArmGrid({"HIGH": (5.5, 7.5), "LOW": (4.5, 6.0)})
    (tmp_path / "state.json").write_text(json.dumps([{"table_name": "mail_offers", "load_column": "wave", "last_extracted_value": None}]))
    state = incremental.StateStore(str(tmp_path / "state.json"))
    seen = []
    for upto in (1, 2, 3, 3):
        made = paths.star(spark, str(tmp_path / "w"), offers.where(F.col("wave") <= upto), clients, grid, state, draws=500, replicates=50)
        seen.append((made["extracted"], made["facts"], made["policy_rows"], state.get("mail_offers")["last_extracted_value"]))
    assert seen == [(300, 300, 0, "1"), (300, 600, 2, "2"), (300, 900, 4, "3"), (0, 900, 4, "3")]
    assert spark.read.parquet(str(tmp_path / "w/bandit_posterior")).groupBy("run_id").count().count() == 3
