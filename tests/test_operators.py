"""Edge cases of cleaning, bandits, incremental loads, items, sources and verdicts."""

import json
import math
from collections import Counter
from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, needs_data
from quern import pipelines
from quern.operators import bandit, cleaning, features, incremental, kv, models
from quern.plans import catalogue
from quern.sources import tables
from quern.verdicts import BANDIT, firewall_fires, verdict


def test_verdicts():
    assert not verdict(True, "no", banned=True) and verdict(True, "yes") and not verdict(False, "0 found")
    assert verdict(True, "x", banned=True, override=True, enforce=True).label == "BANNED"
    assert verdict(True, "x", override=True, limit=True).label == "OVERRIDE" and verdict(True, "x", enforce=True, limit=True).label == "ENFORCE"
    with pytest.raises(ValueError):
        verdict(True, "x", limit=True, allowed=BANDIT)
    with pytest.raises(ValueError):
        verdict(False, "nothing measured")
    assert [firewall_fires(x) for x in (0, 0.0499, 0.05, 0.050001, 0.5)] == [False, False, False, True, True]


def test_self_check_passes():
    assert all(pipelines.self_check().values()) and pipelines.main(["--self-check"]) == 0


def test_modes_break_ties_by_value_and_skip_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("unknown",), ("unknown",), ("unknown",), (None,)], "x string")
    assert cleaning.modes(df, ["x"]) == {"x": "a"}
    assert sorted(str(r[0]) for r in cleaning.impute_modes(df, ["x"]).collect()) == ["None", "a", "a", "a", "a", "b"]


@pytest.mark.parametrize("slice_rows", [13, 500_000])
def test_global_running_count_and_previous(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(cleaning, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 24, 500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, h int").repartition(7)
    got = {r["i"]: r["day"] for r in cleaning.rollovers(df, "i", "h", "day").collect()}
    day, want = 0, {}
    for i, v in enumerate(values):
        day += bool(i and v < values[i - 1])
        want[i] = day
    assert got == want
    assert sorted(map(tuple, cleaning.mint_ids(df.where("i > 9"), "i", "n").select("i", "n").collect())) == [(i, i - 9) for i in range(10, 500)]
    one = spark.createDataFrame([(5, 1)], "i long, h int")
    assert [r["day"] for r in cleaning.rollovers(one, "i", "h", "day").collect()] == [0]


def test_small_cleaners(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.5), (None, 3.0)], "f int, x double")
    assert dict(cleaning.checked_flags(df, ["f"]).dtypes)["f"] == "smallint"
    with pytest.raises(ValueError):
        cleaning.checked_flags(df, ["x"])
    assert cleaning.rename(df, {"y": "x", "z": F.col("x") * 2}).columns == ["y", "z"]
    assert [r["b"] for r in cleaning.bucketize(df, "x", [0.0, 1.0, 2.0, 3.0], "b").collect()] == [0.0, 1.0, 2.0]
    assert cleaning.summary(df, ["x"]).where("summary = 'max'").first()["x"] == "3.0"
    assert cleaning.cast_failures(spark.createDataFrame([("1",), ("x",), (None,)], "t string"), "t", "int").first().asDict() == {"given": 2, "lost": 1}


def test_joins_that_would_multiply_rows_raise(spark):
    df, twice = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError):
        cleaning.join_small(df, twice, "id")


def test_arms_by_join_and_by_cuts_agree_on_boundaries(spark):
    grid = bandit.ArmGrid({"HIGH": (5.5, 7.5), "LOW": (4.5,)})
    df = spark.createDataFrame([("HIGH", r) for r in (-1.0, 5.49, 5.5, 7.5, 99.0)] + [("LOW", 4.5), ("LOW", None), ("?", 1.0)], "band string, rate double")
    rows = grid.join(df, "band", "rate").withColumn("counted", grid.index("band", F.col("rate"))).collect()
    assert len(rows) == 8 and all(r["counted"] == r["arm_index"] for r in rows)
    assert [r["arm_id"] for r in rows if r["band"] == "HIGH"] == [1, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        bandit.ArmGrid({"x": (2.0, 1.0)}).rows()


def test_snips_by_hand_and_batches(spark):
    pi = np.array([0.125, 0.875])
    assert bandit.snips_value(pi, np.array([2.0, 6.0]), np.array([8.0, 8.0])) == pytest.approx(0.6875)
    assert bandit.snips_value(np.array([0.5, 0.5]), np.array([1.0, 0.0]), np.array([4.0, 0.0])) == pytest.approx(0.25)
    with pytest.raises(ValueError):
        bandit.snips_value(pi, np.zeros(2), np.zeros(2))
    df = spark.createDataFrame([(1, 0.125, 8, 2), (1, 0.875, 8, 6), (2, 1.0, 0, 0)], "w int, pi double, pulls long, rewards long")
    assert {r["w"]: r["snips_value"] for r in bandit.snips(df, ["w"]).collect()} == {1: pytest.approx(0.6875), 2: None}


def test_posteriors_keep_the_prior_and_add_up(spark):
    grid = bandit.ArmGrid({"A": (1.0,)})
    facts = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (2, 0.7, 1)], "wave int, rate double, took_up int").withColumn("band", F.lit("A"))
    every = bandit.full_cells(bandit.cells(grid.join(facts, "band", "rate").withColumnRenamed("band", "risk_band")), grid)
    got = {(r["through_wave"], r["arm_id"]): (r["alpha"], r["beta"]) for r in bandit.posterior_by_wave(every).collect()}
    assert got == {(1, 1): (2.0, 2.0), (2, 1): (3.0, 2.0), (1, 2): (1.0, 1.0), (2, 2): (1.0, 1.0)}
    first = bandit.evaluate(every, grid, draws=2000, replicates=50)
    assert first == bandit.evaluate(every, grid, draws=2000, replicates=50)
    assert [v["eval_wave"] for v in first[1]] == [2]


def test_replay_decays_only_the_arm_played():
    alpha, beta, pulls = bandit.replay(np.full((200, 2), np.nan), 7)
    assert pulls.sum() == 200 and np.allclose(alpha, bandit.DISCOUNT**pulls) and np.allclose(beta, alpha)
    alpha, beta, pulls = bandit.replay(np.ones((200, 1)), 7)
    assert alpha[0] == pytest.approx(1 / (1 - bandit.DISCOUNT), rel=0.01) and beta[0] < 0.01
    assert all(np.array_equal(a, b) for a, b in zip(bandit.replay(np.ones((9, 3)), 1), bandit.replay(np.ones((9, 3)), 1), strict=True))


def test_watermarks_are_text(spark):
    df = spark.createDataFrame([("9",), ("10",)], "wave string")
    assert [r[0] for r in incremental.extract(df, "wave", "10").collect()] == ["9"]
    assert incremental.next_watermark(df, "wave", None) == "9" and incremental.next_watermark(df.limit(0), "wave", "3") == "3"
    with pytest.raises(ValueError):
        incremental.next_watermark(df, "wave", "99")
    with pytest.raises(ValueError):
        incremental.advance("10", ["10", "9"], None)
    assert incremental.advance(None, [], "3") == "3"
    with pytest.raises(ValueError):
        incremental.extract(df, None, "3")
    assert incremental.extract_query("mail_offers", "wave", "2", False).endswith("WHERE wave > '2' ORDER BY wave DESC")
    assert incremental.extract_query("mail_offers", None, None, True) == "SELECT * FROM mail_offers"
    with pytest.raises(ValueError):
        incremental.extract_query("x; DROP TABLE y", "wave", None, False)


def test_state_store(tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps([{"table_name": "a", "load_column": "w", "last_extracted_value": None}]))
    store = incremental.StateStore(str(path))
    store.set("a", "3")
    assert store.get("a")["last_extracted_value"] == "3"
    with pytest.raises(KeyError):
        store.set("b", "1")


def test_merges(spark, tmp_path):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    source = spark.createDataFrame([("new", 2), ("new", 3)], "v string, k int")
    once = incremental.merge(target, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "old"), (2, "new"), (3, "new")]
    assert incremental.missing_rows(once, incremental.merge(once, source, ["k"])).first().asDict() == {"only_left": 0, "only_right": 0}
    with pytest.raises(ValueError):
        incremental.merge(target, source.union(source), ["k"])
    path = str(tmp_path / "t")
    target.write.parquet(path)
    incremental.merge_into(spark, path, source, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int")
    assert sorted(map(tuple, incremental.replace_run(runs, spark.createDataFrame([("a", 9)], runs.schema), "a").collect())) == [("a", 9), ("b", 2)]
    with pytest.raises(ValueError):
        incremental.run_name("a'b")


def test_items(spark):
    df = spark.createDataFrame([("x", 1, 5, None), ("y", 2, 5, 2.5)], "g string, k int, c int, v double")
    made = kv.items(df.withColumn("b", F.col("k") == 1), "r#p", ["g"]).collect()
    rows = {r["sk"]: {k: tuple(a) for k, a in r["attrs"].items()} for r in made}
    assert rows["g#x"] == {"g": ("S", "x"), "k": ("N", "1"), "b": ("BOOL", "true")} and rows["#model"] == {"artifact": ("S", "rows"), "artifact_rows": ("N", "2"), "c": ("N", "5")}
    assert {r["sk"]: kv.as_item(r) for r in made}["g#y"] == {"pk": "r#p", "sk": "g#y", "g": "y", "k": Decimal(2), "v": Decimal("2.5"), "b": False}
    for bad in (math.nan, math.inf, 1e200, 1e-200):
        with pytest.raises(ValueError):
            kv.items(df.withColumn("v", F.lit(bad)), "r#p", ["g"])
    assert kv.items(df.withColumn("v", F.lit(1.5e25)), "r#p", ["g"], lift=False).where("sk = 'g#x'").select("attrs.v.value").first()[0] == "1.5E25"
    with pytest.raises(ValueError):
        kv.items(df, "r#p", ["c"])
    with pytest.raises(ValueError):
        kv.items(df.withColumn("g", F.lit("a#b")), "r#p", ["g"])
    assert kv.to_store(True) is True and kv.to_store(0.1) == Decimal("0.1") and kv.to_store(3) == 3
    for bad in (math.nan, math.inf, Decimal("1e200")):
        with pytest.raises(ValueError):
            kv.to_store(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,10.5,2,21,1735689600000000,True,True\n2,10.25,1,10.25,1735689600000001,False,True\n")
    ticks = tables.read_ticks(spark, {"A": str(tmp_path / "t.csv")})
    assert ticks.count() == 2 and dict(ticks.dtypes)["price"] == "decimal(18,8)"
    tables.check_header(spark, str(tmp_path / "t.csv"), "1,10.5,2,21,1735689600000000,True,True".split(","), ",")
    with pytest.raises(ValueError):
        tables.check_header(spark, str(tmp_path / "t.csv"), ["a"], ",")
    empty = spark.createDataFrame([], "a int, b string")
    assert tables.write_csv(empty, str(tmp_path / "e"), single_file=True) == 0
    assert [r[0] for r in spark.read.text(str(tmp_path / "e")).collect()] == ["a,b"]
    assert tables.present(spark, [str(tmp_path / "t.csv"), str(tmp_path / "none")]) == {str(tmp_path / "t.csv"): True, str(tmp_path / "none"): False}
    assert tables.archive(spark, str(tmp_path / "t.csv"), str(tmp_path / "done")).endswith("done/t.csv")


def test_contacts_pipeline(spark, tmp_path):
    names = [f.replace("_", ".") if f in ("emp_var_rate", "cons_price_idx", "cons_conf_idx", "nr_employed") else f for f in pipelines.CONTACTS.fieldNames()]
    jobs = list(pipelines.SECTORS)
    lines = [";".join(f'"{n}"' for n in names)]
    for i in range(60):
        month = ["may", "dec", "mar", "nov"][i // 15]
        lines.append(f'{20 + i};"{jobs[i % 11] if i % 7 else "unknown"}";"married";"basic.4y";"no";"yes";"no";"cellular";"{month}";"mon";{100 + i};{1 + i % 4};{999 if i % 3 else 6};{i % 2};"{"success" if i % 2 else "nonexistent"}";1.1;93.9;-36.4;4.8;5191.0;"{"yes" if i % 5 == 0 else "no"}"')
    lines.append(lines[-1])
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    made = pipelines.run_contacts(spark, str(tmp_path / "c.csv"), str(tmp_path / "curated"), str(tmp_path / "kpi"))
    assert made["curated"] == 60 and made["monthly_kpis"] == 4
    months = [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "kpi/monthly_kpis")).orderBy("contact_date").collect()]
    assert months == ["2008-05-01", "2008-12-01", "2009-03-01", "2009-11-01"]


def test_bars_pipeline(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},{10 + i % 3},1,{10 + i % 3},{i * 4},{i % 2 == 0},True\n" for i in range(10)))
    made = pipelines.run_bars(spark, {"A": str(tmp_path / "a.csv")}, pipelines.bars.Calendar(0, 60, 10), str(tmp_path / "bars"))
    assert made.count() == 6 and made.where("is_missing_bar = 1").count() == 2


def test_features_on_small_frames(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, "a"), (3.0, 6.1, "b"), (4.0, 0.0, "b")], "x double, y double, g string")
    pooled = features.correlation_long(df, ["x", "y"])
    assert pooled.first()["r"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 6.1, 0])[0, 1])
    assert features.sign_flips(pooled, features.correlation_long(df, ["x", "y"], "g")).first()["flips"] == 1
    assert models.select_varying(df.withColumn("k", F.lit(1.0)), ["x", "y", "k"]) == ["x", "y"]
    assert {r["g"]: r["x"] for r in features.fill_group_medians(df.withColumn("x", F.when(F.col("y") > 1, F.col("x"))), "g", ["x"]).where("y = 0").collect()} == {"b": 3.0}


@needs_data
def test_registered_rules_go_down_to_the_support_of_an_hour(spark):
    rules = catalogue.queries()["fpgrowth_rules"](spark, str(DATA)).collect()
    assert any(r["support"] < 0.05 for r in rules) and any(r["confidence"] < 0.6 for r in rules)
    assert all(r["support"] >= 0.003 and r["confidence"] >= 0.5 for r in rules)


def test_rules_of_many_tokens_against_counting(spark):
    """More tokens than one long has bits; each rule and its figures by counting baskets, and no table is sorted twice over for them."""
    rng = np.random.default_rng(3)
    baskets = [sorted({f"t{k:03d}" for k in rng.choice(150, 5, replace=False)} | ({"t000", "t149"} if n % 3 else set())) for n in range(240)] + [[]]
    frame = spark.createDataFrame([(n, b) for n, b in enumerate(baskets)] + [(-1, None)], "bar_us long, items array<string>")
    seen = Counter(s for b in baskets for k in range(1, len(b) + 1) for s in combinations(b, k))
    n, least = len(baskets), -(-len(baskets) * 0.012 // 1)
    want = {}
    for s, c in seen.items():
        for t in s if c >= least and len(s) > 1 else ():
            rest = tuple(x for x in s if x != t)
            if c / seen[rest] >= 0.4:
                want[rest, t] = (c / seen[rest], c / seen[rest] / (seen[t,] / n), c / n)
    assert len({t for s, c in seen.items() if c >= least for t in s}) > 2 * 62 and any(len(s) > 1 for s, _ in want)
    rows = models.association_rules(frame, 0.012, 0.4).collect()
    got = {(tuple(r["antecedent"]), r["consequent"][0]): (r["confidence"], r["lift"], r["support"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert [r["lift"] for r in rows] == sorted((r["lift"] for r in rows), reverse=True)
    assert models.association_rules(frame.where("items IS NULL")).collect() == []


@needs_data
def test_registered_rules_are_mined_in_parts_and_not_sorted(spark, capsys):
    """A total sort of all rules mines them again for its samples, and SQL asks for none; one part mined them all."""
    catalogue.queries()["fpgrowth_rules"](spark, str(DATA)).explain()
    assert "rangepartitioning" not in capsys.readouterr().out.lower()
    frame = spark.createDataFrame([(n, [f"a{n % 3}", f"b{n % 4}", f"c{n % 5}"]) for n in range(60)], "bar_us long, items array<string>").coalesce(1)
    context = spark.sparkContext
    context.setJobGroup("rules", "rules of small baskets")
    try:
        models.association_rules(frame, 0.05, 0.1, ordered=False).collect()
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("rules") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@needs_data
def test_registered_replays_and_draws_are_the_whole_number(spark, monkeypatch):
    made = catalogue.queries()["thompson_replay"](spark, str(DATA))
    assert made.select("replicate").distinct().count() == 200
    seen, evaluate = [], bandit.evaluate

    def noted(*args, **more):
        seen.append(more)
        return evaluate(*args, **more)

    monkeypatch.setattr(bandit, "evaluate", noted)
    for name in ("thompson_policy", "bootstrap_ci"):
        assert catalogue.queries()[name](spark, str(DATA)).count() > 0
    assert seen == [{}, {}]


def test_streams(spark, tmp_path):
    from quern.streaming.bars import streaming_bars, streaming_posterior

    source = tmp_path / "in"
    rows = [(1, "A", 10.0, 1.0, "2024-01-01 00:00:01"), (2, "A", 12.0, 2.0, "2024-01-01 00:00:05"), (3, "A", 9.0, 1.0, "2024-01-01 00:00:11"), (4, "A", 9.0, 1.0, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "trade_id long, symbol string, p double, q double, t string").selectExpr("trade_id", "symbol", "CAST(p AS DECIMAL(18,8)) price", "CAST(q AS DECIMAL(18,8)) qty", "CAST(t AS TIMESTAMP) event_time")
    df.coalesce(1).write.parquet(str(source))
    stream = streaming_bars(spark.readStream.schema(df.schema).parquet(str(source)), "10 seconds", "10 seconds")
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((str(r["bar_open_time_utc"]), float(r["close"]), r["n_ticks"]) for r in spark.table("bars_out").collect())
    assert [g[1:] for g in got] == [(12.0, 2), (9.0, 1)]
    rewards = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", 0.0, 3)], "arm string, reward double, `order` long")
    rewards.coalesce(1).write.parquet(str(tmp_path / "rw"))
    query = streaming_posterior(spark.readStream.schema(rewards.schema).parquet(str(tmp_path / "rw"))).writeStream.format("memory").queryName("arms_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["arm"]: (r["alpha"], r["beta"], r["pulls"]) for r in spark.table("arms_out").collect()}
    g = bandit.DISCOUNT
    assert got["a"] == (pytest.approx((g + 1) * g), pytest.approx(g * g), 2) and got["b"] == (pytest.approx(g), pytest.approx(g + 1), 1)
