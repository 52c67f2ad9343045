from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugework.operators import constraints as q
from gaugework.operators import sampling

POOLS = {"1": 2, "2": 3, "10": 5, "11": 6}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(e, f"{e}/{i}") for e, n in POOLS.items() for i in range(n)]
    return spark.createDataFrame(rows, "entity string, unit string").cache()


def epoch(pool, seed=7, number=0, size=None, **kw):
    rows = sampling.balanced_epoch(pool, "entity", "unit", seed, number, size, **kw).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [(r["entity"], r["unit"]) for r in rows]


@pytest.mark.parametrize("size, number, extra", [(16, 0, []), (17, 0, ["1"]), (17, 1, ["2"]), (17, 3, ["11"]), (18, 1, ["10", "11"]), (19, 1, ["11", "1", "2"]), (19, 4, ["1", "2", "10"])])
def test_quotas_rotate(pool, size, number, extra):
    rows = sampling.epoch_quotas(pool, "entity", number, size).collect()
    base = size // 4
    assert {r["entity"]: r["quota"] for r in rows} == {e: base + (e in extra) for e in POOLS}
    assert [r["entity"] for r in sorted(rows, key=lambda r: r["entity_index"])] == ["1", "2", "10", "11"]


@pytest.mark.parametrize("size, slice_rows", [(None, 10**6), (17, 10**6), (40, 10**6), (40, 2)])
def test_full_passes_before_repeats(pool, size, slice_rows):
    drawn = epoch(pool, size=size, slice_rows=slice_rows)
    assert len(drawn) == (size or 16)
    per = Counter(e for e, _ in drawn)
    assert max(per.values()) - min(per.values()) <= 1
    for e, n in POOLS.items():
        times = Counter(u for x, u in drawn if x == e)
        full, rest = divmod(per[e], n)
        assert sorted(times.values()) == sorted([full + 1] * rest + [full] * (n - rest))[-len(times):]


def test_same_inputs_repeat_whatever_the_layout(pool):
    a = epoch(pool)
    assert a == epoch(pool.orderBy(F.rand(5)).repartition(5), slice_rows=2)
    assert a != epoch(pool, number=1) and a != epoch(pool, seed=8)
    assert [e for e, _ in a] != sorted(e for e, _ in a)


def test_audit_and_report(pool):
    q.require(sampling.epoch_audit(pool, "entity", "unit", 7, 0, 40))
    drawn = sampling.balanced_epoch(pool, "entity", "unit", 7, 0)
    row = sampling.epoch_report(drawn, pool, "entity", "unit").first()
    assert (row["draws"], row["entities"], row["min_draws"], row["max_draws"]) == (16, 4, 4, 4)
    assert row["unique_units"] + row["undrawn"] == 16 and row["repeats"] == 16 - row["unique_units"] == 3
    assert [tuple(r) for r in sampling.draw_distribution(drawn, "entity").collect()] == [(4, 4)]


def test_rotation_closed_form_matches_single_epochs(pool):
    expected = Counter()
    for e in range(5):
        for r in sampling.epoch_quotas(pool, "entity", e, 19).collect():
            expected[r["entity"]] += r["quota"]
    got = {r["entity"]: r["total_draws"] for r in sampling.rotation_totals(pool, "entity", 5, 19).collect()}
    assert got == expected


def test_refusals(pool):
    with pytest.raises(ValueError, match="smaller than the number"):
        epoch(pool, size=3)
    with pytest.raises(ValueError, match="negative"):
        sampling.epoch_quotas(pool, "entity", -1)
