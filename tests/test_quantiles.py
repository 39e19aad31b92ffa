import random
from bisect import bisect_right

import pytest

from ledgerline.functions import quantiles


def within_bounds(rows, state, points_of):
    """The values up to any limit are as many as the summary says, but for its own bound."""
    values = sorted(rows)
    assert state["rows"] == len(values) == sum(state["weights"]) and state["vals"] == sorted(state["vals"]) and len(state["vals"]) <= points_of
    upto, worst = 0, 0
    for v, w in zip(state["vals"], state["weights"], strict=True):
        assert v in values
        worst = max(worst, abs(bisect_right(values, v) - (upto + w)))
        upto += w
    assert worst <= state["off_by_at_most"]


@pytest.mark.parametrize("partitions", [1, 40])
def test_summaries_keep_their_bound(spark, partitions):
    """A key with a third of all rows, a null key, missing values, skewed values, and batches that are small against the summary."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", None, "x", "y", "z", f"k{rng.randrange(9)}"]) if i % 3 else "hot", rng.choice([None, 1.0, rng.paretovariate(0.5), float(i)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        states = {r["key"]: r for r in quantiles.quantile_states(df, "key", "value", 64).collect()}
        halves = [quantiles.quantile_states(df.where(f"pmod(hash(value), 2) = {i}"), "key", "value", 64) for i in (0, 1)]
        merged = {r["key"]: r for r in quantiles.merged_quantile_states(halves[0].union(halves[1]), "key", 64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for found in (states, merged):
        assert set(found) == {k for k, v in rows if v is not None}
        for key, state in found.items():
            within_bounds([v for k, v in rows if k == key and v is not None], state, 64)
    assert 0 < states["hot"]["off_by_at_most"] <= states["hot"]["rows"] / 64 * 4


def test_few_distinct_values_are_exact(spark):
    df = spark.range(5000).selectExpr("1 as key", "cast(id % 50 as double) as value").repartition(9)
    found = quantiles.quantile_states(df, "key", "value").select("off_by_at_most", *[quantiles.quantile(p) for p in (0, 20, 21, 500, 1000)]).first()
    assert tuple(found) == (0, 0.0, 0.0, 1.0, 24.0, 49.0)
    assert quantiles.quantile_states(df.limit(0), "key", "value").count() == 0
    assert quantiles.quantile_states(df.selectExpr("key", "cast(null as double) as value"), "key", "value").count() == 0
