import pytest
from pyspark.sql import functions as F

from ledgerline.functions.vectorised import Instalments, drawdowns
from ledgerline.plans import evaluation
from ledgerline.sources import connector, ingest, profiles
from ledgerline.sources.shared import shared_folder
from ledgerline.sources.tables import left_records, right_evidence

FIELDS = "record_id long, amount decimal(18,2)"


def test_csv_files_keep_bad_rows_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("record_id,amount\n1,2.50\nx,3.00\n4,oops\n5,\n")
    good, bad = ingest.split_bad(ingest.read_csv(spark, str(tmp_path), FIELDS).cache())
    assert sorted(r["record_id"] for r in good.collect()) == [1, 5]
    assert sorted(r[ingest.BAD] for r in bad.collect()) == ["4,oops", "x,3.00"]
    assert good.where(ingest.required(good, "amount")).first()["record_id"] == 5


def test_json_files_keep_bad_rows_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"record_id": 1, "amount": 2.5}\n{"record_id": \n')
    good, bad = ingest.split_bad(ingest.read_json(spark, str(tmp_path), FIELDS).cache())
    assert [r["record_id"] for r in good.collect()] == [1] and bad.count() == 1


def test_profiles_depend_on_the_seed_alone(spark):
    one = profiles.synthetic_profile(spark, 300, seed=1)
    assert one.repartition(5).exceptAll(profiles.synthetic_profile(spark, 300, seed=1)).count() == 0
    assert one.exceptAll(profiles.synthetic_profile(spark, 300, seed=2)).count() > 250
    assert {r["kind"] for r in one.select("kind").distinct().collect()} == set(profiles.KINDS)


def test_connector_splits_its_ledgers(spark):
    connector.register(spark)
    df = spark.read.format("ledger_pages").options(first="5", ledgers="250", entries="3").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 750
    assert df.select("ledger", "entry").distinct().count() == 750
    assert spark.read.format("ledger_pages").options(ledgers="0").load().count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_instalments_add_up(spark):
    df = spark.createDataFrame([(10, 3), (2, 4), (None, 2), (7, 0)], "units long, parts int")
    df.createOrReplaceTempView("due")
    spark.udtf.register("instalments", Instalments)
    found = spark.sql("select units, sum(due_units) as total, count(*) as n from due, lateral instalments(units, parts) group by units").collect()
    assert sorted((r["units"], r["total"], r["n"]) for r in found) == [(2, 2, 4), (10, 10, 3)]


def test_drawdowns_of_each_key(spark):
    rows = [("a", 1, 5), ("a", 3, -9), ("a", 2, 4), ("a", 4, 1), ("b", 1, -3), ("b", 2, -1), ("c", 1, 2)]
    found = drawdowns(spark.createDataFrame(rows, "k string, o int, u long"), "k", "o", "u").collect()
    assert sorted(map(tuple, found)) == [("a", 9), ("b", 4), ("c", 0)]
    assert drawdowns(spark.createDataFrame([], "k string, o int, u long"), "k", "o", "u").count() == 0
