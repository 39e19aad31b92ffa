from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars, vectorised
from ledgerline.functions.canonical import normalised_key, row_hash, table_digests


def hashes(df):
    return df.select(row_hash(df).alias("h")).distinct().count()


def test_nested_values_don_t_collide(spark):
    arrays = spark.createDataFrame([(["a,b"],), (["a", "b"],), ([None],), (["~"],), ([],), (None,), (["a|b"],), (["a\\pb"],), ([""],)], "x array<string>")
    assert hashes(arrays) == 9
    structs = spark.createDataFrame([((1, "a|=2"),), ((1, "a"),), ((1, None),), (None,), ((None, None),)], "x struct<a: int, b: string>")
    assert hashes(structs) == 5
    maps = spark.createDataFrame([({"a": "b"},), ({"a": None},), ({"a=": "b"},), ({},), (None,)], "x map<string, string>")
    assert hashes(maps) == 5
    one, two = (spark.sql(f"select map({x}) as x") for x in ("'a', 1, 'b', 2", "'b', 2, 'a', 1"))
    assert hashes(one.union(two)) == 1
    with pytest.raises(TypeError):
        row_hash(spark.createDataFrame([([1.5],)], "x array<double>"))


def test_an_instant_has_one_hash_in_every_zone(spark):
    df = spark.sql("select timestamp '2024-05-01 12:00:00 UTC' as x")
    found = set()
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.add(df.select(row_hash(df)).first()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == 1


def test_keys_of_every_script(spark):
    df = spark.createDataFrame([("東京",), ("Москва ",), (" Fund / A--1 ",), ("हिन्दी",)], "x string")
    assert [r[0] for r in df.select(normalised_key(F.col("x"))).collect()] == ["東京", "москва", "fund-a-1", "हिन्दी"]


def test_digests_of_empty_tables(spark):
    df = spark.range(3)
    found = {r["part"]: r for r in table_digests({"a": df, "b": df.limit(0), "c": df.repartition(2)}).collect()}
    assert (found["a"]["n_rows"], found["b"]["n_rows"]) == (3, 0) and found["a"]["digest"] == found["c"]["digest"] != found["b"]["digest"]


def test_scalars(spark):
    df = spark.createDataFrame([("12", '{"k": "x"}', [1, 20]), ("no", "[", []), (None, None, None)], "a string, j string, v array<long>")
    found = df.select(scalars.typed(F.col("a"), "int", -1), scalars.typed(F.col("a"), "int"), scalars.json_text("j", "k"), scalars.json_field("j", "k", "int"), scalars.sum_above("v", 5), scalars.joined_text("v", lambda x: x + 1)).collect()
    assert [tuple(r) for r in found] == [(12, 12, "x", None, 20, "2,21"), (-1, None, None, None, 0, ""), (-1, None, None, None, None, None)]


def test_net_positions_of_counted_values(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 7, 2), (1, None, 9), (2, None, 1)], "k int, q long, n long")
    assert {r[0]: r[1] for r in df.groupBy("k").agg(vectorised.net_position("q", "n")).collect()} == {1: 2 * 5 + 2 * 7 - 4 * 5, 2: 0}


def test_drawdowns_of_a_key_in_many_groups(spark):
    values = [(i * 7919) % 101 - 52 for i in range(400)]
    rows = [(1 << 60, i, v) for i, v in enumerate(values)] + [(None, i, -1) for i in range(5)] + [((1 << 60) + 1, 0, 3), (4, 0, None)]
    running = peak = worst = 0
    for v in values:
        running += v
        peak = max(peak, running)
        worst = max(worst, peak - running)
    found = vectorised.drawdowns(spark.createDataFrame(rows, "k long, o int, u long").repartition(5), "k", "o", "u", group_rows=20)
    assert {r["k"]: r["drawdown_units"] for r in found.collect()} == {1 << 60: worst, None: 5, (1 << 60) + 1: 0, 4: 0}
    assert table_digests({"a": spark.createDataFrame([(Decimal("1.50"),)], "x decimal(9,2)")}).count() == 1
