import random
from datetime import datetime, timedelta, timezone
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.canonical import row_hash, table_digest
from ledgerline.operators.reconcile import Profile, _sets, reconcile, reconcile_by_kind, split_settlements, tolerance_matches
from ledgerline.plans import evaluation
from ledgerline.sources.tables import left_records, right_evidence

SCHEMA = "record_id long, amount decimal(18,2), event_ts timestamp_ntz"


def rows(spark, values):
    typed = [(k, a, t) for k, a, t in values]
    return spark.createDataFrame(typed, "record_id long, amount string, event_ts string").select("record_id", F.col("amount").cast("decimal(18,2)"), F.col("event_ts").cast("timestamp_ntz"))


def test_every_class(spark):
    day, next_day = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    left = rows(spark, [(1, "5.00", day), (2, "5.00", day), (4, "5.00", day), (5, "5.00", day), (6, "5.00", day), (7, "5.00", day), (8, None, day), (9, "1.00", day), (9, "1.00", day), (None, "3.00", day)])
    right = rows(spark, [(1, "5.00", day), (3, "5.00", day), (4, "5.00", day), (4, "5.00", day), (5, "6.00", next_day), (6, "5.01", day), (7, "5.00", next_day), (8, "5.00", day), (9, "1.00", day), (None, "3.00", day)])
    found = {r["record_id"]: (r["class"], r["flags"]) for r in reconcile(left, right).collect()}
    assert found == {
        1: ("matched", []), 2: ("missing_right", ["missing_right"]), 3: ("missing_left", ["missing_left"]), 4: ("duplicate_right", ["duplicate_right"]), 5: ("amount_mismatch", ["amount_mismatch", "date_mismatch"]),
        6: ("within_tolerance", ["within_tolerance"]), 7: ("date_mismatch", ["date_mismatch"]), 8: ("inconclusive", ["inconclusive"]), 9: ("duplicate_left", ["duplicate_left"]), None: ("matched", []),
    }


def test_a_repeated_key_gives_a_row_that_somebody_sent(spark):
    first, third = "2024-01-01 00:00:00", "2024-01-03 00:00:00"
    left, right = rows(spark, [(1, "5.00", first)]), rows(spark, [(1, "5.00", third), (1, "6.00", first), (1, None, first)])
    found = reconcile(left, right).first()
    assert (str(found["right_amount"]), found["right_ts"].day, found["class"], found["flags"]) == ("5.00", 3, "duplicate_right", ["duplicate_right", "date_mismatch"])


def test_a_kind_listed_twice_has_its_least_tolerance(spark):
    side = lambda amount: rows(spark, [(1, amount, "2024-01-01 00:00:00")]).withColumn("kind", F.lit("F"))
    tolerances = spark.createDataFrame([("F", "0.50"), ("F", "2.00")], "kind string, tolerance string").select("kind", F.col("tolerance").cast("decimal(18,2)"))
    assert [r["class"] for r in reconcile_by_kind(side("5.00"), side("6.00"), tolerances).collect()] == ["amount_mismatch"]


def test_each_key_has_one_class_and_sides_mirror(spark, sf_dir):
    left, right = left_records(spark, sf_dir), right_evidence(spark, sf_dir)
    there = reconcile(left, right)
    assert there.count() == left.select("record_id").union(right.select("record_id")).distinct().count()
    back = {r["class"]: r["n"] for r in reconcile(right, left).groupBy("class").agg(F.count("*").alias("n")).collect()}
    mirror = {"missing_left": "missing_right", "missing_right": "missing_left", "duplicate_right": "duplicate_left"}
    assert back == {mirror.get(r["class"], r["class"]): r["n"] for r in there.groupBy("class").agg(F.count("*").alias("n")).collect()}


def test_empty_sides(spark, sf_dir):
    left = left_records(spark, sf_dir)
    assert {r["class"] for r in reconcile(left, left.limit(0)).select("class").distinct().collect()} == {"missing_right"}
    assert reconcile(left.limit(0), left.limit(0)).count() == 0


def test_tolerance_of_days(spark):
    left, right = rows(spark, [(1, "5.00", "2024-01-01 00:00:00")]), rows(spark, [(1, "5.00", "2024-01-03 00:00:00")])
    assert reconcile(left, right, Profile(days_tolerance=2)).first()["class"] == "matched"
    assert reconcile(left, right, Profile(days_tolerance=1)).first()["class"] == "date_mismatch"


def test_the_digest_ignores_order_and_sees_every_change(spark, sf_dir):
    base = right_evidence(spark, sf_dir)
    digest = table_digest(base).first()
    assert table_digest(base.repartition(7).orderBy(F.rand(3))).first() == digest
    changed = base.withColumn("amount", F.when(F.col("record_id") == 3, F.col("amount") + F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("amount")).cast("decimal(18,2)"))
    assert table_digest(changed).first()["digest"] != digest["digest"]
    assert table_digest(base.union(base.limit(1))).first()["digest"] != digest["digest"]
    assert table_digest(base.limit(0)).first()["n_rows"] == 0


def test_encodings_don_t_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("a\\p", "c"), ("", "")], "x string, y string")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 6
    with pytest.raises(TypeError):
        row_hash(spark.createDataFrame([(1.5,)], "x double"))


def test_evaluation_ids_depend_on_the_profile(spark, sf_dir):
    left, right = left_records(spark, sf_dir), right_evidence(spark, sf_dir)
    ids = set()
    for p in (Profile(), Profile(amount_tolerance="0.00"), Profile()):
        ids.add(evaluation.manifest(left, right, evaluation.evaluate(left, right, p), p).first()["evaluation_id"])
    assert len(ids) == 2


def test_tolerance_matches_by_trying_all_pairs(spark):
    rng = random.Random(3)
    side = lambda n: [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else rng.choice("ab"), None if rng.random() < 0.05 else rng.randrange(-300, 300)) for _ in range(n)]
    for cents in (0, 1, 7):
        left, right = side(60), side(50)
        of = lambda x: spark.createDataFrame(x, "k string, c int").selectExpr("k", "cast(c / 100.0 as decimal(18,2)) as amount")
        found = sorted((r["k"], round(r["amount"] * 100), round(r["right_amount"] * 100)) for r in tolerance_matches(of(left), of(right), "k", f"{cents / 100:.2f}").collect())
        assert found == sorted((k, a, b) for k, a in left for j, b in right if None not in (k, a, b) and k == j and abs(a - b) <= cents)


def test_settlements_by_trying_all_sets(spark):
    rng = random.Random(4)
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    due = [(rng.choice("abc"), i, rng.choice([None, *range(1, 40)]), day(rng.randrange(0, 30))) for i in range(40)] + [("hot", 100, 9, day(1)), ("hot", 101, 77, day(1)), (None, 102, 5, day(1))]
    paid = [(rng.choice("abc"), i, rng.choice([None, *range(-3, 20)]), day(rng.randrange(0, 30))) for i in range(30)] + [("hot", 200 + i, 9, day(1)) for i in range(20)] + [(None, 300, 5, day(1))]
    of = lambda x: spark.createDataFrame(x, "k string, id long, a int, ts timestamp").selectExpr("k", "id", "cast(a as decimal(18,2)) as amount", "ts")
    found = {r["id"]: (r["n_entries"], r["class"], r["paid_by"]) for r in split_settlements(of(due), of(paid), "k", 10, "1.00", most=8).collect()}
    period = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp()) // (10 * 86_400)
    for k, i, amount, ts in due:
        own = sorted((j, p) for c, j, p, t in paid if k is not None and c == k and period(t) == period(ts) and p is not None)
        sets = [(n, [j for j, _ in x]) for n in range(1, (1 if len(own) > 8 else len(own)) + 1) for x in combinations(own, n) if amount is not None and abs(sum(p for _, p in x) - amount) <= 1]
        expect = ("settled", min(sets)[1]) if sets else ("inconclusive" if amount is None or len(own) > 8 else "unsettled", None)
        assert found[i] == (len(own), *expect), i
    assert len(found) == len(due)


def test_sets_of_large_amounts_and_the_first_of_several(spark):
    """Amounts of 18 digits whose sums pass 64 bits; of sets alike the one whose ids come first; and no set is tried that is larger than asked for."""
    top = "9999999999999999.99"
    due = spark.createDataFrame([("a", 1, "30.00"), ("b", 2, "6.00"), ("c", 3, "0.01"), ("d", 4, top)], "k string, id long, a string")
    paid = [("a", i, "10.00") for i in range(20, 12, -1)] + [("b", i, str(i)) for i in (1, 2, 3)] + [("c", i, top) for i in range(10)] + [("d", 1, top[:-1] + "8"), ("d", 2, "0.01")]
    of = lambda df: df.selectExpr("k", "id", "cast(a as decimal(18,2)) as amount", "timestamp_ntz'2024-01-01 00:00:00' as ts")
    entries = of(spark.createDataFrame(paid, "k string, id long, a string"))
    for largest, three in ((None, [1, 2, 3]), (2, None)):
        found = {r["id"]: r["paid_by"] for r in split_settlements(of(due), entries, "k", 10, largest=largest).collect()}
        assert found == {1: three and [13, 14, 15], 2: three, 3: None, 4: [1, 2]}


def test_sets_are_tried_by_arrays_not_row_by_row(spark):
    """Of 12 entries with sets of up to 3, no expression goes through the 4,095 sets of any size."""
    rows = spark.range(1).selectExpr("'a' as k", "id", "cast(id as decimal(18,2)) as amount", "timestamp_ntz'2024-01-01 00:00:00' as ts")
    assert len(_sets(12, 3)[0]) == 12 + 66 + 220
    assert "ArrowEvalPython" in split_settlements(rows, rows, "k", 10)._jdf.queryExecution().executedPlan().toString()


def test_manifests_of_the_same_inputs_share_their_digests(spark, sf_dir):
    left, right = left_records(spark, sf_dir), right_evidence(spark, sf_dir)
    results, inputs = evaluation.evaluate(left, right), evaluation.input_digests(left, right)
    shared = evaluation.manifest(left, right, results, inputs=inputs)
    assert shared.collect() == evaluation.manifest(left, right, results).collect()
    reads = evaluation.manifest(left, right, left, inputs=inputs)._jdf.queryExecution().executedPlan().toString()
    assert reads.count("FileScan") == 1
