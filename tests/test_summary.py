import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import summary


def test_ranks_over_ranges_are_those_of_windows(spark):
    """Keys and values with a third of all rows, few distinct values, nulls, and small keys."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"k{rng.randrange(6)}"]), rng.choice([5, 5, 5, None, rng.randrange(30)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "kind string, amount long, id long").repartition(7)
    w = Window.partitionBy("kind").orderBy(F.col("amount").desc_nulls_last())
    exact = Window.partitionBy("kind").orderBy(F.col("amount").desc_nulls_last(), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        expected = df.withColumns({"place": F.row_number().over(exact), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "quarter": F.ntile(4).over(exact)})
        assert sorted(map(repr, summary.ranked(df, "kind", "amount", "id").collect())) == sorted(map(repr, expected.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert summary.ranked(df.limit(0), "kind", "amount", "id").count() == 0


def test_duplicates_and_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", None, f"k{rng.randrange(40)}"]), rng.choice([None, rng.randrange(9)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, amount long, id long").repartition(5)
    w = Window.partitionBy("kind").orderBy("id")
    expected = df.withColumns({"copies": F.count("*").over(Window.partitionBy("kind")), "copy_no": F.row_number().over(w)}).where("copies > 1")
    assert sorted(map(repr, summary.duplicates(df, ["kind"], ["id"]).collect())) == sorted(map(repr, expected.collect()))
    running = df.withColumns({"place": F.row_number().over(w).cast("long"), "sum_amount": F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    assert sorted(map(repr, summary.numbered(df, ["kind"], ["id"], ("amount",)).collect())) == sorted(map(repr, running.collect()))
    assert summary.duplicates(df.limit(0), ["kind"], ["id"]).count() == 0


def test_merged_sketches_are_as_good_as_one_pass(spark):
    for distinct in (4000, 20_000):
        df = spark.range(60_000).selectExpr("id % 7 as part", f"xxhash64(id % {distinct}) as value")
        merged = summary.estimated(summary.merged_sketches(summary.distinct_sketches(df, ["part"], "value"), [])).first()
        once = summary.estimated(summary.distinct_sketches(df, [], "value")).first()
        assert merged["rows"] == once["rows"] == 60_000 and abs(merged["estimate"] - distinct) <= merged["off_by_at_most"] < distinct / 18
        assert abs(merged["estimate"] - once["estimate"]) <= merged["off_by_at_most"]
    assert len(merged["sketch"]) < 16 * 4096


def test_dealt_sketches_are_exact_beyond_what_one_keeps(spark):
    """20,000 values, one group without any, nulls: a single sketch estimates, sketches of parts count."""
    df = spark.range(60_000).selectExpr("id % 7 as month", "if(id % 5 = 0, 'none', 'some') as kind", "if(id % 5 = 0 or id % 11 = 0, null, id % 20000) as value")
    parts = summary.sketch_parts(df, "value")
    assert parts > 4 and summary.sketch_parts(df.where("value is null"), "value") == 1
    stored = summary.dealt_sketches(df, ["kind", "month"], "value", parts)
    for dealt in (summary.merged_sketches(stored, ["kind", "part"]), summary.dealt_sketches(df, ["kind"], "value", parts)):
        found = {r["kind"]: (r["rows"], r["estimate"], r["off_by_at_most"]) for r in summary.estimated_parts(dealt, ["kind"]).collect()}
        assert found == {r["kind"]: (r["n"], r["d"], 0) for r in df.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("d")).collect()}


def test_movements_over_blocks_are_those_of_windows(spark):
    """A hot account, times that tie and are missing, amounts that are null, and blocks of three rows."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None, 3 + rng.randrange(5)]), i, rng.choice([None, start + timedelta(hours=12 * rng.randrange(20))]), rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "account int, id long, ts timestamp_ntz, amount long").withColumn("amount", F.col("amount").cast("decimal(18,2)")).repartition(5)
    w = Window.partitionBy("account").orderBy("ts", "id")
    day = Window.partitionBy("account").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    total = lambda frame: F.sum("amount").over(frame).cast("decimal(38,2)")
    expected = df.withColumns({
        "balance": total(w.rowsBetween(Window.unboundedPreceding, 0)), "previous": F.lag("amount").over(w), "following": F.lead("amount").over(w),
        "last_three": total(w.rowsBetween(-2, 0)), "within_day": F.count("*").over(day),
    })
    for block_rows in (3, 1 << 16):
        assert sorted(map(repr, summary.movements(df, "account", ["ts", "id"], block_rows).collect())) == sorted(map(repr, expected.collect()))
    assert summary.movements(df.limit(0), "account", ["ts", "id"]).count() == 0
    ends = {r["id"]: r["end"] for r in summary.until_next(df.select("account", "id", "ts"), "account", ["ts", "id"]).collect()}
    assert ends == {r["id"]: r["next"] for r in df.select("id", F.lead("ts").over(w).alias("next")).collect()}
