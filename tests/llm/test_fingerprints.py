import hashlib
import random

import numpy as np

from ledgerline.llm.fingerprints import KMER, TUPLE, OrderMinHash, edit_likeness, likeness, order_minhash
from tests.llm.conftest import odd_rows


def brute_signature(minhash, text):
    """The definition, element by element, from the same k-mer hashes."""
    h, at = minhash.elements(text)
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    from ledgerline.llm.common import mixed

    out = []
    x = [int(v) >> 32 for v in mixed(h)]
    for flip, factor in zip(minhash.flip[:, 0].tolist(), minhash.factor[:, 0].tolist(), strict=True):
        least = sorted(range(len(x)), key=lambda i: ((x[i] ^ flip) * factor) % (1 << 32))[:TUPLE]
        total = np.zeros(1, np.uint64)
        for i in sorted(least, key=lambda i: at[i]):
            total = mixed(total + h[i])
        out.append(int(total[0]) >> 32)
    return np.array(out, np.uint32)


def test_signature_follows_the_definition():
    rng, minhash = random.Random(1), OrderMinHash(16)
    for n in (0, 1, KMER - 1, KMER, KMER + 1, 200, 9000):
        text = "".join(rng.choice("abcdef é") for _ in range(n))
        assert (minhash.signature(text) == brute_signature(minhash, text)).all()


def test_occurrences_are_numbered():
    h, at = OrderMinHash().elements("abcdefgh" * 6)
    assert len(set(h.tolist())) == len(h) == len("abcdefgh" * 6) - KMER + 1
    assert sorted(at.tolist()) == list(range(len(h)))


def test_order_matters_where_the_set_of_kmers_hardly_changes():
    rng, minhash = random.Random(2), OrderMinHash(256)
    parts = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(4)]
    text, swapped = "".join(parts), "".join([parts[2], parts[3], parts[0], parts[1]])
    one_edit = text[:800] + "#" + text[801:]
    assert likeness(minhash.signature(text), minhash.signature(swapped)) < 0.75 < 0.9 < likeness(minhash.signature(text), minhash.signature(one_edit))


def successor_table(rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    ordered = sorted(rows, key=key)
    return [(a, ordered[(i + 1) % len(ordered)]) for i, a in enumerate(ordered)]


def test_query_against_brute_force(make_docs):
    rng = random.Random(3)
    rows = [(rng.randrange(10_000), "".join(rng.choice("abcde \n") for _ in range(rng.randrange(0, 90))), "s") for _ in range(150)]
    rows = list({r[0]: r for r in rows}.values()) + odd_rows()[:5]
    rows = list({r[0]: r for r in rows}.values())
    minhash, expected = OrderMinHash(), {}
    for (i, text, _), (_, nxt, _) in successor_table(rows):
        text, nxt = text or "", nxt or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        a, b, c = (minhash.signature(x) for x in (text, edited, nxt))
        expected[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), round(likeness(a, b), 9), round(likeness(a, c), 9))
    found = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in edit_likeness(make_docs(rows, clashing=True)).collect()}
    assert found == expected
    assert {r["doc_id"]: r["fingerprint"] for r in order_minhash(make_docs(rows)).collect()} == {k: v[2] for k, v in expected.items()}


def test_odd_tables(make_docs):
    rows = odd_rows()
    found = edit_likeness(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 8}) == 1
    assert {r["near_next"] for r in found if r["doc_id"] == 8} & {1.0}
    assert edit_likeness(make_docs([])).count() == 0
    one = edit_likeness(make_docs([(5, "only one document here", "a")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 22
    assert edit_likeness(make_docs([(None, "x", "a"), (None, "y", "a")])).count() == 2


def test_many_rows_without_an_id_or_with_one_id(make_docs, monkeypatch):
    """A third has no doc_id, a third one and the same, in different texts and in one; ranges end within them."""
    monkeypatch.setattr("ledgerline.llm.fingerprints._OUTPUT_ROWS", 16)
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    many = text()
    rows = [(None, text(), "s") for _ in range(100)] + [(7, text(), "s") for _ in range(100)] + [(7, many, "s")] * 150 + [(None, many, "s")] * 90 + [(100 + i, text(), "s") for i in range(60)]
    found = edit_likeness(make_docs(rows)).collect()
    assert len(found) == len(rows)
    minhash = OrderMinHash()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in found) == sorted((i or -1, minhash.signature(t).astype(">u4").tobytes().hex()) for i, t, _ in rows)
    # A chain: each row has the start of one other row's text at its end, and none twice but for repeats.
    followers = {}
    for i, t, _ in rows:
        for _, other, _ in {(0, o, 0) for _, o, _ in rows}:
            followers.setdefault((i, hashlib.sha256((t[:45] + other[:15]).encode()).hexdigest()), other)
    after = [followers[r["doc_id"], r["edited_sha256"]] for r in found]
    assert sorted(after) == sorted(t for _, t, _ in rows)
    same = hashlib.sha256((many[:45] + many[:15]).encode()).hexdigest()
    assert sum(r["edited_sha256"] == same for r in found) == 149 + 89
