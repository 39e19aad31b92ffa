import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.prefix_trie import ORACLE_SQL, conversation_trie, numbered_turns, prefix_trie
from ledgerline.llm.queries import QUERIES
from tests.conftest import same_rows

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    found = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c > 0 else -1)
        found[c] = turns.get(donor, [])[:h] + t[h:]
    return found


def brute_trie(found):
    """The trie by walking all its nodes."""
    nodes: dict = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, convs in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = lambda x: [p for p in nodes if len(p) == len(x) + 1 and p[:-1] == x]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in convs if len(found[c]) == len(prefix))
        out.append((min(convs), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(convs), len(children(prefix)), sum(not children(p) for p in below), saved, sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-20, 3 * n), n):
        for turn in range(rng.randrange(0, 12)):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "user", "user", None]), rng.choice(["a", "a", "a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_the_trie_by_walking_it(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "2 as b", "'x' as unit", "0 as depth", "3 as pos").repartition(4)
    assert told(conversation_trie(df)) == brute_trie(rebuilt(rows))


def as_they_are(conversations):
    """Conversations as the trie takes them, without shared turns."""
    turns = numbered_turns(conversations)
    begun = turns.where("pos = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("x", "y", "bytes")])
    return begun.union(turns.select("conv_id", F.lit(2), "pos", "x", "y", "bytes"))


def test_deep_and_hot(spark):
    """Two copies of a conversation with two thirds of all rows, and many that share its first turn."""
    long = [("user", f"turn {i}") for i in range(400)]
    found = {1: long, 2: long, 3: long[:200], 4: long[:100] + [("user", "other")]} | {c: [long[0], ("assistant", str(c % 7))] for c in range(10, 200)}
    rows = [(c, i, *t) for c, turns in found.items() for i, t in enumerate(turns)]
    expect = {(x[0], x[1]): x for x in told(prefix_trie(as_they_are(spark.createDataFrame(rows, SCHEMA))))}
    assert len(expect) == 1 + 400 + 1 + 7
    texts = [len(t.encode()) for _, t in long]
    assert expect[1, 0][3:7] == (194, 1, 9, 193 * texts[0] + 3 * sum(texts[1:100]) + 2 * sum(texts[100:200]) + sum(texts[200:]) + sum(sum(1 for c in range(10, 200) if c % 7 == k) - 1 for k in range(7)))
    assert expect[1, 400][3:7] == (2, 0, 1, texts[-1]) and expect[1, 400][7] == sha256(b"1,2").hexdigest()
    assert expect[1, 200][7] == sha256(b"3").hexdigest() and expect[4, 101][2:5] == (1, 1, 0)


def test_odd_tables(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (9, 0, "user", "y" * 300_000)]
    assert told(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(rebuilt(rows))


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op12_prefix_trie"](spark, sf_dir), duck, ORACLE_SQL)
