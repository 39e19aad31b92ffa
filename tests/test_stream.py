from datetime import datetime, timedelta

from ledgerline.streaming import stream

START = datetime(2024, 1, 1)


def test_late_rows_are_counted_within_the_delay(spark):
    rows = [("a", i % 3, START + timedelta(minutes=10 * ((7 * i) % 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "kind string, n int, ts timestamp_ntz").selectExpr("kind", "cast(n as decimal(18,2)) as amount", "ts").repartition(6)
    found = stream.run_to_end(stream.windowed_totals(stream.staged(df, "ts", "12 hours"), "ts", "1 hour", "kind")).where(stream.before_closing("window_start"))
    assert {r["n"] for r in found.collect()} == {6} and found.count() == 10


def test_deduplication_keeps_one_of_each(spark):
    rows = [(i % 4, START + timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "key int, ts timestamp_ntz")
    found = stream.run_to_end(stream.deduplicated(stream.staged(df, "ts", "2 hours"), "key")).where(stream.before_closing("ts"))
    assert sorted(r["key"] for r in found.collect()) == [0, 1, 2, 3]


def test_full_outer_join_gives_rows_without_a_partner(spark):
    a = spark.createDataFrame([(1, START), (2, START)], "key int, left_ts timestamp_ntz")
    b = spark.createDataFrame([(1, START + timedelta(minutes=5)), (3, START)], "right_key int, right_ts timestamp_ntz")
    joined = stream.interval_joined(stream.staged(a, "left_ts", "1 hour"), stream.staged(b, "right_ts", "1 hour"), "key", "10 minutes", "full_outer")
    found = stream.run_to_end(joined).where(stream.before_closing("left_ts") | stream.before_closing("right_ts"))
    assert sorted((r["key"] or 0, r["right_key"] or 0) for r in found.collect()) == [(0, 3), (1, 1), (2, 0)]


def test_rows_beyond_the_delay_are_reported(spark):
    """Files come in any order, so what a short delay loses differs; that it loses some is always told."""
    rows = [("a", START + timedelta(hours=h)) for h in range(48)] + [("a", START + timedelta(minutes=1))]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "kind string, i int, ts timestamp_ntz").selectExpr("kind", "cast(1 as decimal(18,2)) as amount", "ts", "i")
    ordered = df.repartitionByRange(7, "i").sortWithinPartitions("i").drop("i")
    for delay, late in (("2 hours", True), ("60 hours", False)):
        found, dropped = stream.run_counting_late(stream.windowed_totals(stream.staged(ordered, "ts", delay, files_at_once=1), "ts", "1 day", "kind"))
        counted = found.where(stream.before_closing("window_start")).groupBy().sum("n").first()[0]
        assert (dropped > 0) == (counted < 49)
        assert late or counted == 49
