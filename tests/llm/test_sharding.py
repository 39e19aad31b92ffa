import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm.sharding import edited, first_map, rebalanced, shard_documents, slot_of, store_map, stored_map, write_shards
from tests.llm.conftest import odd_rows


def test_edits_even_the_shards_and_move_little():
    rng = np.random.default_rng(1)
    for n, shards in ((4096, 8), (500, 7), (16, 8)):
        sizes = np.round(rng.pareto(1.5, n) * 1000).clip(0, 1e5)
        start = np.arange(n) % shards
        found = edited(sizes, start, shards)
        load, mean = np.bincount(found, sizes, shards), sizes.sum() / shards
        assert np.ptp(load) <= max(np.ptp(np.bincount(start, sizes, shards)) * 0.5, 0.001 * mean) or sizes.max() > 0.5 * mean
        assert (edited(sizes, found, shards) == found).all()
    assert (found != start).mean() < 0.9
    assert (edited(np.zeros(8), np.arange(8) % 2, 2) == np.arange(8) % 2).all()


def test_a_new_shard_takes_slots_from_all():
    sizes = np.random.default_rng(2).integers(900, 1100, 4096).astype(float)
    before = edited(sizes, np.arange(4096) % 8, 8)
    after = edited(sizes, before, 9)
    moved = after != before
    assert (after[moved] == 8).mean() > 0.95 and abs(moved.mean() - 1 / 9) < 0.01


def test_places_and_shards(make_docs):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([10, 100, 1000]) + "é", "s") for i in range(500)]
    found = shard_documents(make_docs(rows, clashing=True)).collect()
    text = {i: t for i, t, _ in rows}
    load, places = {}, {}
    for r in found:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) < 0.01 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = shard_documents(make_docs(rows).repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_map_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "map")
    one = first_map(spark, 4, 64)
    sizes = spark.range(10_000).select(slot_of(F.col("id"), 64).alias("slot")).groupBy("slot").agg(F.sum(F.expr("slot % 5 + 1")).alias("bytes"))
    store_map(one, path)
    store_map(rebalanced(stored_map(spark, path), sizes, 4), path)
    store_map(rebalanced(stored_map(spark, path), sizes, 5), path)
    assert stored_map(spark, path).select("version").distinct().collect()[0][0] == 3
    assert stored_map(spark, path, 1).exceptAll(one).count() == 0
    assert stored_map(spark, path).where("shard = 4").count() > 0 and stored_map(spark, path).count() == 64


def test_documents_are_placed_by_a_stored_map(spark, make_docs, tmp_path):
    path = str(tmp_path / "map")
    found = shard_documents(make_docs([(i, "x" * (i % 90), "s") for i in range(300)]), map_path=path).collect()
    assert stored_map(spark, path, 1).exceptAll(first_map(spark)).count() == 0
    newest = {r["slot"]: (r["shard"], r["version"]) for r in stored_map(spark, path).collect()}
    assert len(newest) == 4096 and len(found) == 300
    assert all(newest[r["virtual_slot"]] == (r["shard"], r["map_version"]) for r in found)


def test_shards_are_written_whole(spark, make_docs, tmp_path):
    docs = make_docs(odd_rows() + [(100 + i, f"text {i}", "s") for i in range(300)], clashing=True)
    write_shards(docs, first_map(spark), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("doc.*").exceptAll(docs).count() == 0 and written.count() == docs.count()
    assert sorted(r[0] for r in written.select("shard").distinct().collect()) == list(range(8))


def test_rows_of_a_repeated_id_are_written_where_they_are_placed(spark, make_docs, tmp_path):
    """A third of the rows have one id, some of them alike; others none, or 0."""
    rows = [(7 if i % 3 == 0 else None if i % 20 == 1 else 0 if i % 20 == 2 else i, f"text {i % 50}", "s") for i in range(300)]
    docs = make_docs(rows)
    placed = shard_documents(docs, map_path=str(tmp_path / "map"))
    expect = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"]) for r in placed.collect())
    write_shards(docs, stored_map(spark, str(tmp_path / "map")), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    found = [((t := (r["doc"]["text"] or "").encode()), r["doc"]["doc_id"], r["shard"]) for r in written]
    assert sorted((i is None, i or 0, len(t) + 1, zlib.crc32(t), s) for t, i, s in found) == expect


def test_odd_tables(make_docs):
    rows = odd_rows()
    found = shard_documents(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert {r["size"] for r in found if r["doc_id"] in (1, 2)} == {1} and {r["text_crc32"] for r in found if r["doc_id"] == 1} == {0}
    assert shard_documents(make_docs([])).count() == 0


def brute(rows, slot_shard, slots):
    """Contract columns of (doc_id, text) rows by a plain map from slot to shard, slots being those of the records."""
    found = []
    for (i, text), slot in zip(rows, slots, strict=True):
        data = (text or "").encode()
        found.append((-1 if i is None else i, len(data) + 1, zlib.crc32(data), slot_shard[slot]))
    return sorted(found)


def test_contract_columns_by_brute_force(make_docs):
    """A third of the rows has no doc_id, a third one and the same; sizes are even all the same."""
    rng = random.Random(6)
    text = lambda: "é" * rng.randrange(0, 400)
    rows = [(None, text()) for _ in range(700)] + [(5, "the same row again and again " * 9)] * 700 + [(100 + i, text()) for i in range(700)] + [(9, None), (10, "")]
    found = shard_documents(make_docs([(i, t, "s") for i, t in rows], clashing=True)).collect()
    sizes = np.zeros(4096)
    for r in found:
        sizes[r["virtual_slot"]] += r["size"]
    by_map = edited(sizes, np.arange(4096) % 8, 8)
    assert all(by_map[r["virtual_slot"]] == r["shard"] for r in found)
    # Records are told apart by id, size and crc; rows that are alike may stand for one another.
    keyed = lambda i, size, crc: (-1 if i is None else i, size, crc)
    slots = {}
    for r in found:
        slots.setdefault(keyed(r["doc_id"], r["size"], r["text_crc32"]), []).append(r["virtual_slot"])
    dealt = [slots[keyed(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))].pop() for i, t in rows]
    assert brute(rows, by_map, dealt) == sorted((*keyed(r["doc_id"], r["size"], r["text_crc32"]), r["shard"]) for r in found)
    load = np.bincount([r["shard"] for r in found], [r["size"] for r in found], 8)
    assert np.ptp(load) < 0.01 * load.mean()
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert max(np.bincount([r["virtual_slot"] for r in found], minlength=4096)) < 12
