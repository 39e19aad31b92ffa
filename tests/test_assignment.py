import random

import pytest

from ledgerline.operators.timejoin import stable_assignment

SIDE = "k string, id long, ts timestamp"


def side(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, s double").selectExpr("k", "id", "timestamp_micros(cast(s * 1000000 as bigint)) as ts")


def greedy(left, right, within=None):
    """The pairs by distance, nearest first, as long as both are free."""
    pairs = sorted((abs(a[2] - b[2]), a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] is not None and b[2] is not None)
    found, gone = [], set()
    for apart, i, j in pairs:
        if (within is None or apart <= within) and ("l", i) not in gone and ("r", j) not in gone:
            gone |= {("l", i), ("r", j)}
            found.append((i, j, round(apart * 1_000_000)))
    return sorted(found)


@pytest.mark.parametrize(("seed", "within"), [(1, None), (2, 40)])
def test_no_pair_would_rather_be_together(spark, seed, within):
    rng = random.Random(seed)
    keys = ["hot"] * 30 + list("abcdefgh") + [None]
    make = lambda n, start: [(rng.choice(keys), start + i, None if rng.random() < 0.03 else float(rng.randrange(0, 600))) for i in range(n)]
    left, right = make(90, 0), make(70, 1000)
    found = sorted(tuple(r) for r in stable_assignment(side(spark, left), side(spark, right), "k", within, seconds=100).collect())
    null_safe = [tuple(x) for x in found]
    assert len({i for i, _, _ in found}) == len({j for _, j, _ in found}) == len(found)
    assert [x for x in null_safe if next(r[0] for r in left if r[1] == x[0]) is not None] == greedy(left, right, within)


def test_nobody_to_ask(spark):
    some, none = side(spark, [("a", 1, 5.0), ("b", 2, 6.0)]), side(spark, [])
    assert stable_assignment(some, none, "k").count() == stable_assignment(none, some, "k").count() == 0
    assert stable_assignment(some, side(spark, [("c", 3, 5.0)]), "k").count() == 0
