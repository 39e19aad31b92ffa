import random
import re
from itertools import combinations

import numpy as np
import pytest

from ledgerline.llm import ngram_join
from ledgerline.llm.components import connected_components
from ledgerline.llm.ngram_join import class_bounds, class_plan, least_partner, light_classes, ngram_jaccard_join, one_of_each
from ledgerline.llm.queries import QUERIES
from tests.conftest import same_rows
from tests.llm.conftest import odd_rows


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op5_ngram_jaccard_join"](spark, sf_dir), duck, ngram_join.ORACLE_SQL)


def brute(rows, width, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(width, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()

    sets = [(i, shingles(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(range(len(sets)), 0)
    for (a, (i, s)), (b, (j, t)) in combinations(enumerate(sets), 2):
        common = len(s & t)
        if common and 100 * common >= percent * (len(s) + len(t) - common):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i), links[n]) for n, (i, s) in enumerate(sets)}


def near_copies(seed, groups=8, words=120):
    rng, rows = random.Random(seed), []
    vocabulary = [f"v{i}" for i in range(400)]
    for g in range(groups):
        n = rng.choice([5, 9, 12, 20, words, words])
        base = [rng.choice(vocabulary) for _ in range(n)]
        passage = ["shared", "passage"] * 3
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], [rng.choice(vocabulary)], [copy[at], "added"]])
            if g % 2:
                copy += passage
            rows.append((len(rows) * 3 + 1, " ".join(copy).title() if rng.random() < 0.2 else "\n".join(copy), "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (3, 90, 2), (5, 80, 3), (2, 50, 4)])
def test_join_by_brute_force(make_docs, width, percent, seed):
    rows = near_copies(seed)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard_join(make_docs(rows, clashing=True), width, percent).collect()}
    assert found == brute(rows, width, percent)


@pytest.mark.parametrize("share", [0, 1e9])
def test_light_and_heavy_sides_agree(make_docs, monkeypatch, share):
    """All sets in lists, or all enumerated; with blocks so small that they are cut into chunks."""
    monkeypatch.setattr(ngram_join, "LIGHT_SHARE", share)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    rows = near_copies(5, groups=8, words=26)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard_join(make_docs(rows), 3, 90).collect()}
    assert found == brute(rows, 3, 90)


def test_sizes_that_can_link_meet_in_a_class():
    for percent in (50, 80, 90):
        bounds = class_bounds(3000, percent)
        of = lambda s: sum(b <= s for b in bounds) - 1
        plan = class_plan(bounds, percent)
        for b in range(bounds[0], 3000, 7):
            a = -(-percent * b // 100)
            if a < bounds[0]:
                continue
            assert of(b) - of(a) in (0, 1)
            if of(a) != of(b):
                assert 100 * a >= percent * bounds[of(a) + 1]
            assert a + b - 2 * a <= plan[of(b)].differ and least_partner(b, percent) == a


def test_the_boundary_follows_the_sizes():
    plan = class_plan(class_bounds(5000, 90), 90)
    assert light_classes({0: 10}, plan) == 0
    assert light_classes({0: 100, 1: 100, 4: 100, 12: 5000}, plan) == 4
    assert light_classes({0: 1, 1: 1, 2: 1, 4: 1, 6: 9, 12: 500_000}, plan) == 6
    assert max(c.subsets for c in class_plan(class_bounds(20_000, 80), 80)) > 1 << 40


def test_small_sets_enumerate_the_subsets_that_their_partners_ask_for():
    """Of 11 elements at 90 percent: themselves, for a partner of 12, and those of 10, which a partner of 11 asks for."""
    keys = lambda s: set(np.concatenate(ngram_join._subset_keys([np.array(s, np.uint64)], np.zeros(1, np.int64), 90, 15)[0]).tolist())
    eleven = keys(range(11))
    assert len(eleven) == 12 and all(len(eleven & keys([x for x in range(11) if x != i])) == 1 for i in range(11))
    assert len(eleven & keys([*range(10), 99])) == 1 and len(eleven & keys(range(12))) == 1 and not eleven & keys([*range(9), 98, 99])


def test_all_alike_or_nothing(make_docs):
    rows = [(1, "one two three four", "s"), (2, "ONE two three\nfour", "s"), (3, "one two three four five", "s")]
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(make_docs(rows), 2, 100).collect()} == {1: 1, 2: 1, 3: 3}


def test_rows_that_share_an_id_are_one_node_and_null_ids_link(make_docs):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (9, b + "more", "s"), (None, c, "s"), (None, c + "more", "s"), (None, c, "s"), (None, b, "s")]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_links"]) for r in ngram_jaccard_join(make_docs(rows), 3, 80).collect())
    assert found == [(0, 0, 2), (0, 0, 2), (0, 0, 2), (0, 3, 2), (3, 3, 1), (5, 3, 1), (5, 3, 2), (9, 3, 2)]


def test_one_row_of_each_group_stays(make_docs):
    """Copies under other ids, without id, and rows that repeat the one that stays."""
    text = " ".join(f"w{i}" for i in range(60))
    near = [(10 + i, f"{text} end{i}", "s") for i in range(4)]
    rows = [*near, (10, near[0][1], "s"), (10, near[0][1], "s"), (None, text, "s"), (None, None, "s"), (None, None, "s"), (7, "", "s"), (50, "a text of its own", "s"), (None, "without id and " + text[::-1], "s"), (None, "without id and " + text[::-1], "t")]
    docs = make_docs(rows, clashing=True)
    found = one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found.collect()) == sorted([(10, near[0][1]), (0, ""), (0, ""), (7, ""), (50, "a text of its own"), (0, "without id and " + text[::-1])])
    assert one_of_each(make_docs([])).count() == 0
    # Ids with other texts too: what is no copy stays, and of what is, one.
    other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "xy")
    rows = [(3, text, "s"), (5, text, "s"), (5, other, "s"), (6, third, "s"), (6, third + " end", "s"), (6, other + " end", "s")]
    kept = [r["text"] for r in one_of_each(make_docs(rows)).collect()]
    assert len(kept) == 3 and [sum(t.startswith(x) for t in kept) for x in ("w0", "x0", "y0")] == [1, 1, 1]


@pytest.mark.parametrize("broadcast", [1 << 18, 0])
def test_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr("ledgerline.llm.components.BROADCAST_EDGES", broadcast)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500), (None, 3), (7, 41)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {x: root(x) for x in parent}
    # A hub at the end that is larger than all of its neighbours, and one that is less.
    hubs = [(i, 10_000) for i in range(3000)] + [(-1, 20_000 + i) for i in range(3000)]
    assert {r["component"] for r in connected_components(spark.createDataFrame(hubs, "a long, b long")).collect()} == {0, -1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_tables(make_docs):
    rows = odd_rows()
    found = ngram_jaccard_join(make_docs(rows), 3, 90).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found if r["doc_id"] not in (None, 8)}
    assert (by[1]["component_id"], by[1]["n_shingles"], by[2]["component_id"], by[4]["n_shingles"]) == (1, 0, 2, 1)
    assert by[7]["component_id"] == 6 and by[6]["n_links"] == 1
    assert ngram_jaccard_join(make_docs([]), 3, 90).count() == 0
    copies = ngram_jaccard_join(make_docs([(i, "exactly the same words", "s") for i in range(9)]), 3, 90).collect()
    assert {(r["component_id"], r["class_id"], r["n_links"]) for r in copies} == {(0, 0, 8)}


@pytest.mark.parametrize(("percent", "light"), [(90, 0), (90, 4), (80, 0), (80, 3), (50, 0), (50, 3)])
def test_sets_that_link_share_a_key_whatever_is_frequent(percent, light):
    """On the edge of the threshold, with any share of a pair's elements listed as frequent."""
    rng = np.random.default_rng(percent + light)
    bounds = class_bounds(700, percent)
    plan = class_plan(bounds, percent)
    for trial in range(400):
        size = int(rng.integers(bounds[0], 2 * bounds[light] if light and trial % 2 else 600))
        larger = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        # The most that can go from, or be swapped in, a set that still links.
        swaps = max(n for n in range(len(larger)) if 100 * (len(larger) - n) >= percent * (len(larger) + n)) if trial % 2 else 0
        drops = 0 if swaps else max(n for n in range(len(larger)) if 100 * (len(larger) - n) >= percent * len(larger))
        kept = rng.permutation(larger)[: len(larger) - swaps - drops]
        other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, swaps, np.uint64)]))
        pool = np.union1d(larger, other)
        # Frequent ones may all be on one side's own part, which makes that side alone sparse.
        frequent = np.sort(rng.choice(pool, int(rng.uniform(0, 1) * len(pool)), replace=False)) if trial % 3 else np.sort(kept[: int(rng.uniform(0.7, 1) * len(kept))])
        keys = [set(ngram_join._signatures([s], np.zeros(1, np.int64), bounds, plan, light, percent, frequent)[0].tolist()) for s in (larger, other)]
        assert keys[0] & keys[1] or (larger == other).all()


def test_phrases_in_common_bring_no_sets_together():
    """Long sets that have some common shingles each, and a near copy each: the copies meet, and nearly nothing else does."""
    rng = np.random.default_rng(4)
    bounds = class_bounds(3000, 80)
    plan = class_plan(bounds, 80)
    phrases = rng.integers(0, 1 << 63, 40, np.uint64)
    sets = []
    for _ in range(300):
        own = rng.integers(0, 1 << 63, int(rng.integers(900, 1100)), np.uint64)
        with_phrases = np.concatenate([own, rng.choice(phrases, 8, replace=False)])
        sets += [np.unique(with_phrases), np.unique(np.concatenate([with_phrases[60:], own[:50] + np.uint64(1)]))]
    a, b = ngram_join._stars(*ngram_join._signatures(sets, np.arange(len(sets)), bounds, plan, 0, 80, np.empty(0, np.uint64)))[2:]
    met = set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(i, i + 1) for i in range(0, len(sets), 2)} <= met and len(met) < 1.1 * len(sets) / 2


def test_components_that_don_t_converge_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("ledgerline.llm.components.MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
