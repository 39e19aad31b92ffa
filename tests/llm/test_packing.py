import random

from ledgerline.llm.packing import best_fit_packing, bin_texts, pack
from tests.llm.conftest import odd_rows


def brute(items, capacity):
    """Best fit by scanning every bin; as pack() in everything else."""
    bins, out = [], []
    tails = [x for x in items if x[1] % capacity]
    for doc, size, source, cluster in sorted(tails, key=lambda x: (-(x[1] % capacity), x[0] is not None, x[0] or 0, x[3], x[2])):
        size, piece = size % capacity, size // capacity
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((doc, piece, size, i, capacity - bins[i]["left"]))
        bins[i]["left"] -= size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
    return out


def test_packing_is_best_fit_without_conflicts():
    rng = random.Random(1)
    for n, sources in ((0, 1), (1, 1), (40, 3), (300, 6), (400, 60)):
        hot = lambda: 0 if rng.random() < 0.33 else rng.randrange(sources)
        items = [(i, rng.randrange(1, 250), hot(), rng.randrange(n) if rng.random() < 0.7 else 0) for i in range(n)]
        found = pack(items, 100)
        assert found[: len(brute(items, 100))] == brute(items, 100)
        words = {}
        for doc, _, size, _, _ in found:
            words[doc] = words.get(doc, 0) + size
        assert words == {i[0]: i[1] for i in items}


def check(rows, pieces, capacity):
    bins, source = {}, {i: s for i, _, s in rows}
    for r in pieces:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["start"])
        assert held[0]["start"] == 0 and all(a["start"] + a["n_words"] == b["start"] for a, b in zip(held, held[1:], strict=False))
        assert sum(r["n_words"] for r in held) <= capacity
        assert len({source[r["doc_id"]] for r in held}) == len(held)


def test_bins_of_a_table(make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90))) + f" t{i}", f"s{0 if rng.random() < 0.3 else rng.randrange(9)}") for i in range(400)]
    pieces = best_fit_packing(make_docs(rows, clashing=True), capacity=64, group_rows=100).collect()
    check(rows, pieces, 64)
    assert sum(r["n_words"] for r in pieces) == sum(len(t.split()) for _, t, _ in rows)


def test_bins_hold_all_words(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randrange(0, 150))), f"s{rng.randrange(9)}") for i in range(60)]
    docs = make_docs(rows)
    bins = bin_texts(docs, best_fit_packing(docs, capacity=64, group_rows=30), capacity=64).collect()
    assert sorted(w for r in bins for w in r["text"].split()) == sorted(w for _, t, _ in rows for w in t.split())
    for r in bins:
        assert len(r["text"].split()) == r["n_words"] <= 64
        assert list(dict.fromkeys(int(w[1:].split("w")[0]) for w in r["text"].split())) == r["doc_ids"]


def test_copies_never_share_a_bin(make_docs):
    rows = [(i, "same words in all of them", f"s{i}") for i in range(30)]
    pieces = best_fit_packing(make_docs(rows), capacity=64).collect()
    assert len({r["bin_id"] for r in pieces}) == 30


def test_odd_tables(make_docs):
    rows = odd_rows()
    pieces = best_fit_packing(make_docs(rows)).collect()
    assert sum(r["n_words"] for r in pieces) == sum(len((t or "").split(None)) for _, t, _ in rows)
    assert sum(r["bin_id"] is None for r in pieces) == sum(not (t or "").split() for _, t, _ in rows)
    assert best_fit_packing(make_docs([])).count() == 0


def test_rows_without_an_id_and_repeated_rows_are_spread_over_the_groups(make_docs):
    rows = [(None, "one and the same text", f"s{i % 3}") for i in range(400)] + [(7, "another text that is the same", "t")] * 400 + [(100 + i, f"text of its own {i}", "u") for i in range(400)]
    pieces = best_fit_packing(make_docs(rows, clashing=True), capacity=64, group_rows=100).collect()
    assert len(pieces) == 1200
    groups = {}
    for r in pieces:
        groups[r["bin_id"] >> 32] = groups.get(r["bin_id"] >> 32, 0) + 1
    assert len(groups) == 12 and max(groups.values()) < 200
    held = {}
    for r in pieces:
        held.setdefault(r["bin_id"], []).append(r["doc_id"])
    assert all(x.count(7) < 2 and x.count(None) < 2 for x in held.values())
    again = best_fit_packing(make_docs(rows).repartition(5), capacity=64, group_rows=100).collect()
    assert sorted((r["bin_id"], r["start"], r["n_words"]) for r in again) == sorted((r["bin_id"], r["start"], r["n_words"]) for r in pieces)
