from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import timejoin

START = datetime(2024, 1, 1)
SCHEMA = "key int, id long, ts timestamp_ntz"
ROWS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), max_size=25)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def make(spark, drawn):
    rows = [(k, i, START + timedelta(seconds=s)) for i, (k, s) in enumerate(drawn)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@QUICK
@given(ROWS, ROWS, st.sampled_from([10, 100, 86_400]))
def test_asof_takes_the_latest_before(spark, a, b, seconds):
    (left, l), (right, r) = make(spark, a), make(spark, b)
    found = {x["left_id"]: x["right_id"] for x in timejoin.asof_join(l, r, "key", seconds).collect()}
    for key, i, ts in left:
        before = [(t, j) for k, j, t in right if k == key and t <= ts]
        assert found[i] == (max(before)[1] if before else None)
    assert len(found) == len(left)


@QUICK
@given(ROWS, ROWS, st.integers(1, 90))
def test_band_join_is_the_nested_loop(spark, a, b, seconds):
    (left, l), (right, r) = make(spark, a), make(spark, b)
    found = sorted((x["left_id"], x["right_id"]) for x in timejoin.band_join(l, r, seconds).collect())
    assert found == sorted((i, j) for _, i, s in left for _, j, t in right if abs((t - s).total_seconds()) <= seconds)


@QUICK
@given(ROWS, ROWS, st.integers(0, 60), st.integers(0, 60))
def test_interval_join_is_the_nested_loop(spark, a, b, before, after):
    (left, l), (right, r) = make(spark, a), make(spark, b)
    found = sorted((x["left_id"], x["right_id"]) for x in timejoin.interval_join(l, r, "key", before, after).collect())
    assert found == sorted((i, j) for k, i, s in left for m, j, t in right if k == m and -before <= (t - s).total_seconds() <= after)


@QUICK
@given(ROWS, ROWS, st.sampled_from([10, 100, 86_400]))
def test_mutual_nearest_is_the_best_of_all_pairs(spark, a, b, seconds):
    (left, l), (right, r) = make(spark, a), make(spark, b)
    apart = {(i, j): abs((t - s).total_seconds()) for k, i, s in left for m, j, t in right if k == m}
    best = {i: min((d, j) for (x, j), d in apart.items() if x == i)[1] for i in {i for i, _ in apart}}
    back = {j: min((d, i) for (i, y), d in apart.items() if y == j)[1] for j in {j for _, j in apart}}
    found = {x["left_id"]: (x["right_id"], x["apart"]) for x in timejoin.mutual_nearest(l, r, "key", seconds).collect()}
    assert found == {i: (j, int(apart[i, j] * 1_000_000)) for i, j in best.items() if back[j] == i}


def test_no_join_on_time_gives_the_pairs_of_a_key(spark):
    """A hot key: 2,000 rows on each side, of which few are near one another."""
    rows = spark.range(2000).selectExpr("1 as key", "id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts")
    found = timejoin.interval_join(rows, rows, "key", 0, 0)
    assert found.count() == 2000
    assert "bucket" in found._jdf.queryExecution().optimizedPlan().toString()
    plan = timejoin.mutual_nearest(rows, rows, "key")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("stretch" in x or "left_id" in x for x in joins)


def test_asof_with_nulls(spark):
    left = spark.createDataFrame([(None, 1, START), (1, 2, None), (1, 3, START)], SCHEMA)
    right = spark.createDataFrame([(None, 7, START), (1, 8, None), (1, 9, START - timedelta(days=9))], SCHEMA)
    found = {x["left_id"]: (x["right_id"], x["right_ts"]) for x in timejoin.asof_join(left, right, "key").collect()}
    assert found == {1: (7, START), 2: (None, None), 3: (9, START - timedelta(days=9))}


def test_band_join_has_no_nested_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as id", "ts")
    plan = timejoin.band_join(events, events, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mutual_best_breaks_ties_by_id(spark):
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 11, 9), (3, 12, 1)], "left_id int, right_id int, apart int")
    assert sorted((r["left_id"], r["right_id"]) for r in timejoin.mutual_best(pairs, "apart").collect()) == [(1, 10), (3, 12)]


def test_scans_are_pruned(spark, sf_dir):
    from ledgerline.plans.queries import QUERIES

    plan = QUERIES["pruned_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
