"""Connected components: one task's contraction and rounds against plain reachability, and the jobs that they take."""

import random

import pytest

from quern.llm import components


def plain(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def found(spark, pairs, parts=7):
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(parts)
    rows = [(r["node"], r["root"]) for r in components.connected_components(frame).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("held", [500_000, 40])
def test_either_way_gives_the_same_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held, raising=False)
    rng = random.Random(4)
    chain = list(range(1000, 1120))
    rng.shuffle(chain)
    pairs = list(zip(chain[:-1], chain[1:], strict=True)) + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(-5, 7), (5, 5), (None, 3), (9, None)]
    assert found(spark, pairs) == plain(pairs)


def test_no_links_give_no_rows(spark):
    assert found(spark, [(4, 4), (None, 1)]) == {}


def test_few_links_take_few_jobs(spark):
    """Rounds of joins over a graph that one task can hold filled the driver with tasks' figures and the disk with their files."""
    context = spark.sparkContext
    context.setJobGroup("components", "links of a chain")
    try:
        chain = list(range(400))
        random.Random(2).shuffle(chain)
        assert set(found(spark, list(zip(chain[:-1], chain[1:], strict=True)), 11).values()) == {0}
        assert len(context.statusTracker().getJobIdsForGroup("components")) <= 10
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
