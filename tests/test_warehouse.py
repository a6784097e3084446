"""Merges by partition, staged upserts, seeds, guards, items, exports, the jobs' flows, and the fits against plain ones."""

import json
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from quern import paths, pipelines
from quern.operators import bandit, bars, cleaning, features, incremental, kv, models
from quern.sources import tables
from test_operators import test_contacts_pipeline as contacts_case


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_by_partition_touches_no_other(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a")], "k int, wave int, v string")
    incremental.merge_partitions(spark, path, first, ["k", "wave"], "wave")
    untouched = {p.name for p in (tmp_path / "t/wave=1").glob("*.parquet")}
    incremental.merge_partitions(spark, path, spark.createDataFrame([(3, 2, "b"), (4, 2, "b"), (5, 3, "b")], first.schema), ["k", "wave"], "wave")
    assert rows(spark.read.parquet(path).select("k", "wave", "v")) == [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, 2, "b"), (5, 3, "b")]
    assert {p.name for p in (tmp_path / "t/wave=1").glob("*.parquet")} == untouched
    incremental.merge_partitions(spark, path, first.limit(0), ["k", "wave"], "wave")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        incremental.merge_partitions(spark, path, first, ["k"], "wave")
    with pytest.raises(ValueError):
        incremental.merge_partitions(spark, path, first.union(first), ["k", "wave"], "wave")


def test_staged_upsert_leaves_the_table_on_a_fault(spark, tmp_path):
    path = str(tmp_path / "kpi")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert incremental.upsert_through_stage(one, path, ["k"]) == 2
    assert incremental.upsert_through_stage(spark.createDataFrame([("b", 3), ("c", 4)], one.schema), path, ["k"]) == 2
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        incremental.upsert_through_stage(one.union(one), path, ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 3), ("c", 4)] and not (tmp_path / "tmp_kpi").exists()


def test_a_swap_that_was_cut_off_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "k int").write.parquet(f"{path}.old")
    assert incremental.current(spark, path).count() == 1 and (tmp_path / "t").exists() and not (tmp_path / "t.old").exists()


def test_seed_is_written_once_and_counted(spark, tmp_path):
    path, grid = str(tmp_path / "dim"), paths.MAIL_GRID
    check = {f"risk_band = '{b}'": 6 for b in grid.cuts} | {"rate_ceil IS NULL": 3}
    for _ in range(2):
        incremental.seed(grid.dimension(spark), path, 18, check)
    found = {r["arm_id"]: r for r in spark.read.parquet(path).collect()}
    assert len(found) == 18 and found[1]["arm_label"] == "HIGH 0 [0.00, 5.50)" and found[18]["arm_label"] == "LOW 5 [7.50, +inf)" and found[7]["risk_band"] == "MEDIUM"
    incremental.swap_in(spark.read.parquet(path).where("arm_id < 18"), path)
    with pytest.raises(ValueError):
        incremental.seed(grid.dimension(spark), path, 18, check)


def test_window_is_a_filter_and_the_guard_holds(spark, tmp_path):
    spine = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, wave int")
    spine.write.partitionBy("wave").parquet(str(tmp_path / "s"))
    window = incremental.newest_window(spark.read.parquet(str(tmp_path / "s")), spine.where("wave < 3"), "wave")
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert rows(window.select("wave")) == [(2,), (3,)] and "NestedLoop" not in plan and "PartitionFilters: [isnotnull(wave" in plan
    assert incremental.newest_window(spine, spine.limit(0), "wave").count() == 3
    assert incremental.guarded_watermark(spine, "wave", "1") == "3" and incremental.guarded_watermark(spine.limit(0), "wave", "1") == "1"
    with pytest.raises(ValueError):
        incremental.guarded_watermark(spark.createDataFrame([(9,), (10,)], "wave int"), "wave", None)
    assert incremental.stage_waves(spine, "wave", str(tmp_path / "w")) == {1: 1, 2: 1, 3: 1}


def test_offenders_and_policies(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5), (2, 6), (3, 1)], "k int, v int")
    assert [tuple(r) for r in incremental.offenders(df, ["k"], 1).collect()] == [(1, 3)]
    assert cleaning.by_duplicate_policy(df, ["k"], [F.col("v")], "keep").count() == 6
    assert rows(cleaning.by_duplicate_policy(df, ["k"], [F.col("v")], "drop")) == [(1, 5), (2, 5), (3, 1)]
    for policy in ("raise", "other"):
        with pytest.raises(ValueError):
            cleaning.by_duplicate_policy(df, ["k"], [F.col("v")], policy)


def test_small_joins_with_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    small = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    assert rows(cleaning.join_small(df, small, "k")) == [("a", 1), ("b", None), (None, None)]
    assert cleaning.unmatched(df, small, "k") == 2


def test_exports_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 5.256, "x"), (2, 2, None, ""), (3, 1, 7.0, None)], "id int, wave int, rate double, name string")
    assert tables.write_rates(df, str(tmp_path / "r"), ["rate"]) == 3
    lines = {x[0] for x in spark.read.text(str(tmp_path / "r")).collect()}
    assert {"1,1,5.26,x", '2,2,\\N,""', "3,1,7.00,\\N"} <= lines
    assert tables.write_waves(df, str(tmp_path / "w"), "wave", ["rate"]) == {1: 2, 2: 1}
    assert tables.write_csv(df.where("wave = 1"), str(tmp_path / "one"), single_file=True) == 2
    tables.place_file(spark, str(tmp_path / "one"), str(tmp_path / "fixed.csv"))
    assert (tmp_path / "fixed.csv").read_text().splitlines()[0] == "id,wave,rate,name" and not (tmp_path / "one").exists()
    (tmp_path / "c.csv").write_text('id,rate,name\n1,,""\n2,5.5,x\n')
    assert rows(tables.read_copy(spark, str(tmp_path / "c.csv"), spark.createDataFrame([], "id int, rate double, name string").schema)) == [(1, None, None), (2, 5.5, "x")]
    (tmp_path / "a.tsv").write_text("id\tv\n1\t\\N\n")
    schema = spark.createDataFrame([], "id int, v int").schema
    assert rows(tables.read_tsv(spark, str(tmp_path / "a.tsv"), schema, shape=(1, 2))) == [(1, None)]
    import hashlib

    digest = hashlib.sha256((tmp_path / "a.tsv").read_bytes()).hexdigest()
    assert tables.read_tsv(spark, str(tmp_path / "a.tsv"), schema, sha256=digest).count() == 1
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2\n")
    for more in ({"shape": (3, 2)}, {"shape": (2, 3)}, {"sha256": digest}):
        with pytest.raises(ValueError):
            tables.read_tsv(spark, str(tmp_path / "*.tsv"), schema, **more)


def test_sweep_deletes_orphans_only(spark, tmp_path):
    held = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "pk string, sk string")
    written = spark.createDataFrame([("p", "a")], "pk string, sk string")
    folder = str(tmp_path)

    def delete(keys):
        for pk, sk in keys:
            open(f"{folder}/{pk}-{sk}", "w").close()

    assert kv.sweep(held, written, delete) == 1 and [p.name for p in tmp_path.iterdir()] == ["p-b"]
    assert kv.sweep(written, written, delete) == 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 5000), np.round(rng.standard_normal(5000), 2), strict=True)] + [(9, 1.0)] + [(10, float(i)) for i in range(10)] + [(None, float(i)) for i in range(7)] + [(11, None)]
    df = spark.createDataFrame(data, "g long, v double").withColumn("w", F.col("v") * 2)
    points = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for accuracy in (50, 10_000):
        got = {r["g"]: r for r in cleaning.percentiles(df, ["v", "w"], points, "g", accuracy=accuracy).collect()}
        for r in df.groupBy("g").agg(F.percentile("v", points).alias("v"), F.percentile("w", points).alias("w")).collect():
            if r["v"] is not None and r["g"] != 11:
                assert np.allclose(got[r["g"]]["v"], r["v"]) and np.allclose(got[r["g"]]["w"], r["w"])
        assert cleaning.percentiles(df, ["v"], points, between=False, accuracy=accuracy).first()[0] == df.approxQuantile("v", points, 0.0)
    low, high = cleaning.fences(df.limit(0), "v")
    assert np.isnan(low) and np.isnan(high)


def test_next_value_across_slices(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "SLICE_ROWS", 7)
    rng = random.Random(4)
    data = [(i, rng.choice("abc") if i > 30 else "a", rng.random()) for i in range(90)]
    made = cleaning.following(spark.createDataFrame(data, "t long, s string, v double").repartition(5), "s", "t", "v", "n")
    after = {}
    for t, s, v in reversed(data):
        after[t] = next((x for u, w, x in data if u > t and w == s), None)
    assert {r["t"]: r["n"] for r in made.collect()} == after


def test_ranks_are_those_of_the_fitted_rows(spark):
    dev = spark.createDataFrame([(float(i),) for i in range(100)] + [(50.0,)] * 20, "x double")
    points = features.rank_cuts(dev, ["x"], 20)["x"]
    other = spark.createDataFrame([(-5.0,), (0.0,), (49.5,), (50.0,), (51.0,), (99.0,), (1000.0,), (None,)], "x double")
    got = {r["x"]: r["r"] for r in features.rank_by_cuts(other, "x", "r", points).collect()}
    for x, r in got.items():
        assert r is None if x is None else abs(r - max(sum(p < x for p in points) - 1, 0) / 20) < 1e-12
    assert got[-5.0] == 0.0 and got[1000.0] == 1.0


def test_elastic_net_against_the_library(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 1]
    x[:, 3] = 2.0
    y = 1e-3 * (x[:, 0] + 0.05 * x[:, 1]) + 2e-4 * rng.standard_normal(400)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, y double, fold int")
    ledger, rmse = models.elastic_net(df, ["a", "b", "c", "d"], "y")
    got = ledger.collect()
    made = models.assemble(df, ["a", "b", "c", "d"])
    fit = LinearRegression(labelCol="y", regParam=got[0]["reg_param"], elasticNetParam=got[0]["elastic_net_param"], maxIter=200, tol=1e-12).fit(made)
    assert np.allclose([r["coefficient"] for r in got], fit.coefficients.toArray(), rtol=1e-3, atol=1e-9) and abs(got[0]["intercept"] - fit.intercept) < 1e-6
    assert not got[3]["survived_step9"] and got[3]["mu"] is None and got[0]["n_rows"] == 400 and 0 < rmse < got[0]["target_sd"]
    for reg, net in ((1e-4, 1.0), (1e-5, 0.25), (1e-3, 0.5)):
        sums, centre, scale = models.moments(df, ["a", "b", "c", "d", "y"], "fold")
        b = models.descend(sum(sums.values()), reg, net, float(scale[-1]))
        fit = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=net, maxIter=500, tol=1e-12).fit(made)
        assert np.allclose(b[1:] * scale[-1] / scale[:-1], fit.coefficients.toArray(), rtol=1e-3, atol=1e-9)


def test_lift_interval_and_policy_values():
    pi, won, pulls = np.array([0.125, 0.875]), np.array([2.0, 6.0]), np.array([8.0, 8.0])
    assert bandit.snips_value(pi, won, pulls) == pytest.approx(0.6875) and bandit.snips_value(np.array([0.5, 0.5]), np.array([1.0, 0]), np.array([4.0, 0])) == pytest.approx(0.25)
    with pytest.raises(ValueError):
        bandit.snips_value(np.array([0.0, 1.0]), np.array([1.0, 0]), np.array([4.0, 0]))
    big = np.array([4000.0, 4000.0])
    found = bandit.lift_interval(np.random.default_rng(1), pi, np.array([1000.0, 3000.0]), big, 4000)
    # The lift's mean and deviation by the delta method.
    sd = np.sqrt(sum((p - 0.5) ** 2 * r * (1 - r) / 4000 for p, r in zip(pi, (0.25, 0.75), strict=True)) + 0.25 * 0.25 / 8000)
    assert found["ci_low"] < 0.1875 < found["ci_high"] and found["ci_high"] - found["ci_low"] == pytest.approx(2 * 1.96 * sd, rel=0.15) and found["p_diff_positive"] == 1.0


def test_replays_side_by_side_are_like_single_ones():
    rng = np.random.default_rng(5)
    matrix = (rng.random((400, 3)) < [0.3, 0.5, 0.7]).astype(float)
    matrix[rng.random((400, 3)) < 0.1] = np.nan
    alpha, beta, pulls, observed = bandit.replay_many(matrix, 200, 3)
    assert (pulls.sum(axis=1) == 400).all() and (observed <= pulls).all() and 0.85 < observed.sum() / pulls.sum() < 0.95
    assert pulls[:, 2].mean() > pulls[:, 1].mean() > pulls[:, 0].mean()
    shares = []
    for seed in range(40):
        r, a, b, n = np.random.default_rng(seed), np.ones(3), np.ones(3), np.zeros(3)
        for row in matrix:
            k = int(r.beta(a, b).argmax())
            a[k], b[k] = a[k] * bandit.DISCOUNT, b[k] * bandit.DISCOUNT
            if row[k] == row[k]:
                a[k], b[k] = a[k] + row[k], b[k] + 1 - row[k]
            n[k] += 1
        shares.append(n / 400)
    assert np.allclose(np.mean(shares, axis=0), pulls.mean(axis=0) / 400, atol=0.06)


def test_contacts_flow(spark, tmp_path):
    assert pipelines.contacts_flow(spark, str(tmp_path / "c.csv"), str(tmp_path / "done"), *[str(tmp_path / x) for x in ("curated", "kpi", "wh")])["branch"] == "nothing to do"
    contacts_case(spark, tmp_path)
    made = pipelines.contacts_flow(spark, str(tmp_path / "c.csv"), str(tmp_path / "done"), *[str(tmp_path / x) for x in ("curated2", "kpi2", "wh")])
    assert made["branch"] == "loaded" and made["loaded"]["monthly_kpis"] == 4
    assert not (tmp_path / "c.csv").exists() and (tmp_path / "done/c.csv").exists()
    table = spark.read.parquet(str(tmp_path / "wh/monthly_kpis"))
    assert table.count() == 4 and dict(table.dtypes)["contact_date"] == "date" and spark.read.parquet(str(tmp_path / "wh/segment_level_kpis")).agg(F.sum("contacts")).first()[0] == 60


def test_ticks_flow_and_items(spark, tmp_path):
    rng = random.Random(3)
    for s in "ab":
        price, lines = 10.0, []
        for i in range(900):
            price = max(1.0, price + rng.choice([-0.5, 0.0, 0.5]))
            lines.append(f"{i},{price},{1 + rng.randrange(3)},{price},{i * 1_000_000},{rng.random() < 0.5},{rng.random() < 0.97}")
        (tmp_path / f"{s}.csv").write_text("\n".join(lines) + "\n")
    folder = str(tmp_path / "items")
    (tmp_path / "items").mkdir()

    def put(items):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(json.dumps({k: str(v) for k, v in item.items()}) for item in items))

    made = pipelines.ticks_flow(spark, {s.upper(): str(tmp_path / f"{s}.csv") for s in "ab"}, bars.Calendar(0, 900 * bars.SECOND, 10 * bars.SECOND), str(tmp_path / "out"), "r1", put, replicates=5)
    assert made["bars"] == 180 and made["items"]["online/arms"] == 3
    sent = [json.loads(x) for p in (tmp_path / "items").iterdir() for x in p.read_text().splitlines()]
    assert len(sent) == sum(made["items"].values()) and {"r1#online#arms"} <= {i["pk"] for i in sent}
    assert pipelines.load_items(spark, str(tmp_path / "out"), "r1", put, dry_run=True) == made["items"]
    assert len([1 for p in (tmp_path / "items").iterdir() for _ in p.read_text().splitlines()]) == len(sent)
    with pytest.raises(ValueError):
        pipelines.load_items(spark, str(tmp_path / "out"), "no good", put)


def test_command_line_needs_a_job(capsys):
    assert pipelines.main([]) == 2 and "star" in capsys.readouterr().out
