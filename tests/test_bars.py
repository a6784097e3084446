"""Bars against an independent rebuild in Decimal, and their guards."""

from collections import defaultdict
from decimal import Decimal

import pytest

from quern.operators import bars
from quern.sources.tables import TICKS

D = Decimal
ROWS = [
    # trade_id, price, qty, quote, time, maker, best, symbol; id order is not time order within a bucket
    (1, D(10), D(1), D(10), 0, True, True, "A"),
    (2, D(12), D(2), D(24), 5, False, True, "A"),
    (3, D(9), D(1), D(9), 3, False, False, "A"),
    (4, D(11), D(4), D(44), 10, True, True, "A"),
    (5, D(11), D(4), D(44), 29, True, True, "A"),
    (7, D(5), D("0.1"), D("0.5"), 12, False, True, "B"),
]
CALENDAR = bars.Calendar(0, 40, 10)


@pytest.fixture(scope="module")
def ticks(spark):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TICKS.fields) + ", symbol string"
    return spark.createDataFrame(ROWS, schema)


def test_every_bar_matches_a_rebuild(ticks):
    want = defaultdict(list)
    for r in sorted(ROWS):
        want[r[7], r[4] - r[4] % 10].append(r)
    got = {(r["symbol"], r["bar_us"]): r for r in bars.dense_bars(ticks, CALENDAR, ["A", "B"]).collect()}
    assert len(got) == 2 * CALENDAR.slots
    differ = 0
    for key, row in got.items():
        rows = want.get(key)
        assert row["is_missing_bar"] == (rows is None)
        if rows is None:
            assert row["n_ticks"] == 0 and row["open"] is None and row["volume"] is None
            continue
        prices = [r[1] for r in rows]
        assert (row["open"], row["high"], row["low"], row["close"]) == (prices[0], max(prices), min(prices), prices[-1])
        assert row["volume"] == sum(r[2] for r in rows) and row["quote_volume"] == sum(r[3] for r in rows)
        assert row["taker_buy_qty"] == sum((r[2] for r in rows if not r[5]), D(0))
        assert row["all_best_match"] == all(r[6] for r in rows)
        differ += [r[1] for r in sorted(rows, key=lambda r: r[4])][-1] != prices[-1]
    assert differ, "no bar tells id order from time order"


def test_first_and_last_slots_are_marked(ticks):
    rows = bars.dense_bars(ticks, CALENDAR, ["A"]).collect()
    assert [r["bar_us"] for r in rows if r["is_first_bar"]] == [0] and [r["bar_us"] for r in rows if r["is_last_bar"]] == [30]


def test_sums_do_not_depend_on_partitioning(ticks):
    seen = {tuple(sorted((r["symbol"], r["bar_us"], r["volume"], r["close"]) for r in bars.aggregate(ticks.repartition(n), 10).collect())) for n in (1, 3, 11)}
    assert len(seen) == 1


def test_buckets_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,), (-10,), (-11,), (9,)], "t long").select(bars.bucket("t", 10).alias("b"))
    assert [r["b"] for r in df.collect()] == [-10, -10, -20, 0]


@pytest.mark.parametrize("bad", [(0, 35, 10), (5, 45, 10), (10, 10, 10), (0, 10, 0)])
def test_a_calendar_must_tile(bad):
    with pytest.raises(ValueError):
        bars.Calendar(*bad)


def test_gaps_raise_and_invariants_hold(ticks):
    with pytest.raises(ValueError, match="not contiguous"):
        bars.assert_contiguous(ticks.where("trade_id <> 2"))
    bars.assert_contiguous(ticks)
    dense = bars.densify(bars.aggregate(ticks, 10), CALENDAR, ["A", "B"])
    bars.assert_sound(dense, ticks)
    with pytest.raises(ValueError, match="lost"):
        bars.assert_sound(dense, ticks.union(ticks))


def test_load_bars_guards(spark, ticks, tmp_path):
    dense = bars.dense_bars(ticks, CALENDAR, ["A", "B"])
    dense.write.parquet(str(tmp_path / "ok"))
    loaded = bars.load_bars(spark, str(tmp_path / "ok"))
    assert (loaded.symbols, loaded.interval_us, loaded.slots, loaded.rows) == (["A", "B"], 10, 4, 8)
    for name, df in {"hole": dense.where("NOT (symbol = 'A' AND bar_us = 10)"), "short": dense.where("bar_us = 0"), "untiled": dense.where("bar_us <> 10"), "columns": dense.drop("close"), "empty": dense.limit(0)}.items():
        df.write.parquet(str(tmp_path / name))
        with pytest.raises(ValueError):
            bars.load_bars(spark, str(tmp_path / name))
