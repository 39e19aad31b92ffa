import numpy as np
import pytest

from ledgerline.llm.hnsw import NEAREST, build_graph, build_index, load_graph, nearest_vectors, search_index

SCHEMA = "vec_id long, embedding array<float>"


def plain_score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute(rows, every=20, nearest=NEAREST):
    """Each query's nearest among all rows but itself; of rows alike in id and vector each is a query."""
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (i, v) in enumerate(usable):
        if i is not None and i % every == 0:
            others = [(-plain_score(u, v), j is None, j or 0) for n, (j, u) in enumerate(usable) if n != q and len(u) == len(v)]
            out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(others)[:nearest])]
    return sorted(out, key=repr)


def told(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def recall(found, true):
    of = lambda rows: {(q, i) for q, _, i, _ in rows}
    return len(of(found) & of(true)) / len(of(true))


def test_small_shards_find_all(spark):
    """Graphs smaller than a walk is wide are searched whole."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    assert told(nearest_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_rows=100)) == brute(rows)


@pytest.mark.parametrize("lengths", [0.0, 0.6])
def test_recall_of_large_shards(spark, lengths):
    """Vectors without structure, the hardest to find, of one length and of many."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 48))
    x *= (rng.lognormal(0, lengths, size=3000) / np.linalg.norm(x, axis=1))[:, None]
    rows = list(enumerate(x.tolist()))
    found, true = told(nearest_vectors(spark.createDataFrame(rows, SCHEMA), shard_rows=1500)), brute(rows)
    assert len(found) == len(true) and recall(found, true) >= 0.93
    scores = {(q, i): s for q, _, i, s in brute(rows, nearest=3000)}
    assert all(scores[q, i] == s for q, _, i, s in found)


def test_a_third_are_one_vector_and_a_third_near_it(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=32)
    rows = [(i, (hot if i % 3 == 0 else hot + 0.01 * rng.normal(size=32) if i % 3 == 1 else rng.normal(size=32)).tolist()) for i in range(1500)]
    found, true = told(nearest_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), shard_rows=400)), brute(rows)
    assert recall(found, true) >= 0.97
    # Equal scores go by id, and a query is not a candidate to itself.
    assert [r for r in found if r[0] == 0] == [r for r in true if r[0] == 0]
    assert all(q != i for q, _, i, _ in found)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [1.0, 1.0, 1.0]), (160, [1.0, 0.5, 1.0]), (None, [1.0, 2.0]), (None, [0.5, 0.5]), (7, [-1.0, 4.0]), (180, [1e-30, 1e-30]), (5, [3.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "'x' as vector", "2 as rank", "3 as score", "4 as query_id")
    assert told(nearest_vectors(df)) == brute(rows)
    assert nearest_vectors(df.where("vec_id < 0")).count() == 0
    assert told(nearest_vectors(spark.createDataFrame([(20, [1.0, 1.0])], SCHEMA))) == []


def test_the_index_holds_every_vector_and_other_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    index, shards = build_index(spark.createDataFrame(rows, SCHEMA), 40)
    graphs = [load_graph(r.asDict()) for r in index.collect()]
    assert shards == 3 and sorted(i for *_, ids in graphs for i in ids) == list(range(90))
    asked = spark.createDataFrame([(1000, rng.normal(size=6).tolist())], SCHEMA)
    assert [r["rank"] for r in search_index(index, shards, asked, 5).collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        search_index(index, shards, asked, NEAREST + 1)


def test_links_are_of_the_level_and_reach_all():
    rng = np.random.default_rng(5)
    graph = build_graph(rng.normal(size=(700, 16)))
    for members, links, place in zip(graph.members, graph.links, graph.place, strict=True):
        assert set(links[links >= 0].tolist()) <= set(members.tolist())
        assert all((links[place[m]] != m).all() for m in members)
    found = graph.search(graph.points, 700)
    assert all(set(f.tolist()) == set(range(700)) for f in found[:5])
