from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import overlaps

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LENGTHS = st.sampled_from([0, 1, 2, 3, 7, 60, 3600, 86_400, 400 * 86_400])
DRAWN = st.lists(st.tuples(st.integers(0, 1), st.integers(-(10**5), 10**7), LENGTHS), max_size=25)


def common(left, right):
    return sorted((k, i, j, max(s, t), min(e, f)) for k, i, s, e in left for m, j, t, f in right if k == m and max(s, t) < min(e, f))


@QUICK
@given(DRAWN, DRAWN, st.sampled_from([0, 3, 20]))
def test_overlaps_are_those_of_all_pairs(spark, a, b, granule):
    left, right = ([(k, i, s, s + n) for i, (k, s, n) in enumerate(side)] for side in (a, b))
    schema = "key int, id long, start long, end long"
    found = overlaps.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "key", granule)
    assert sorted(map(tuple, found.collect())) == common(left, right)


@QUICK
@given(DRAWN, DRAWN)
def test_overlaps_in_time_from_seconds_to_years(spark, a, b):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left, right = ([(k, i, at(s), at(s + n)) for i, (k, s, n) in enumerate(side)] for side in (a, b))
    schema = "key int, id long, start timestamp_ntz, end timestamp_ntz"
    found = overlaps.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "key")
    assert sorted(map(tuple, found.collect())) == common(left, right)


def test_what_overlaps_nothing(spark):
    rows = spark.createDataFrame([(None, 1, 0, 9), (1, 2, None, 9), (1, 3, 0, None), (1, 4, 9, 0), (1, 5, 4, 4), (1, 6, 0, 9)], "key int, id long, start long, end long")
    assert [tuple(r) for r in overlaps.overlap_join(rows, rows, "key", 0).collect()] == [(1, 6, 6, 0, 9)]
    assert overlaps.overlap_join(rows.limit(0), rows, "key").count() == overlaps.overlap_join(rows, rows.limit(0), "key").count() == 0


def test_a_hot_key_makes_no_pairs_but_those_that_overlap(spark):
    """3,000 intervals of one key, one after the other, beside one that spans them all."""
    short = spark.range(3000).selectExpr("1 as key", "id", "id * 1000 as start", "id * 1000 + 1000 as end")
    long = spark.range(1).selectExpr("1 as key", "3000 as id", "0L as start", "3000000L as end")
    found = overlaps.overlap_join(short.union(long), short, "key", 0)
    assert found.count() == 6000
    joined = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined
    # The blocks of an interval are few, and hold each of its granules once.
    covered = spark.sql(f"with i as (select id as a, id * 37 + 11 as b from range(1, 200)) select a, b, {overlaps._COVER} as cover from i").collect()
    for r in covered:
        held = Counter(g for n in r["cover"] for g in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert held == Counter(range(r["a"], r["b"])) and len(r["cover"]) <= 2 * (r["b"] - r["a"]).bit_length()


def first_in_first_out(rows):
    """Lot by lot, as one would by hand."""
    found = Counter()
    for key in {r[0] for r in rows} - {None}:
        mine = sorted((t, i, u) for k, i, t, u in rows if k == key and u)
        lots, gone = ([[i, abs(u)] for _, i, u in mine if (u > 0) == side] for side in (True, False))
        while lots and gone:
            n = min(lots[0][1], gone[0][1])
            found[key, lots[0][0], gone[0][0]] += n
            for side in (lots, gone):
                side[0][1] -= n
                if not side[0][1]:
                    side.pop(0)
    return sorted((*k, n) for k, n in found.items())


@QUICK
@given(st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.integers(0, 9), st.one_of(st.none(), st.integers(-300, 300))), max_size=40), st.sampled_from([0, 4, 16]))
def test_lots_are_used_up_first_in_first_out(spark, drawn, granule):
    rows = [(k, i, t, u) for i, (k, t, u) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "key int, id long, day int, units long").repartition(3)
    found = overlaps.fifo_lots(df, "key", ["day", "id"], "units", granule)
    assert sorted(map(tuple, found.collect())) == first_in_first_out(rows)
