import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from ledgerline.llm.toxicity import toxic_documents
from tests.llm.conftest import odd_rows
from tests.llm.test_mixing import brute_targets
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_packing import brute as brute_packing

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def stages_of(spark, docs, sf_dir, tmp_path):
    found = {"documents": docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = found[name] = spark.read.parquet(str(tmp_path / str(i)))
    return list(found.values())


def groups_of(rows, width, percent):
    """The least of the rows' numbers that each is linked with, by comparing all pairs of (number, text)."""
    return {n: root for n, (_, root, _) in brute_groups([(n, t, None) for n, t in rows], width, percent).items()}


def brute_quality(docs):
    """(doc_id, text) of the documents that the quality rules keep, in plain Python."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    normal = lambda x: b" ".join(re.sub(rb"[1-9]", b"0", x.encode().lower()).split())
    texts = sorted({t for _, t, _ in docs})
    lines = {t: [(normal(x), len(word.findall(x))) for x in t.split("\n") if word.search(x)] for t in texts}

    def frequent(name):
        seen = {}
        for row, (_, t, host) in enumerate(docs):
            for x, _ in lines[t]:
                seen.setdefault((host, x), set()).add(name(row, t))
        return {k for k, names in seen.items() if len(names) > 20}

    def left(t, host, gone):
        return sum(n for x, n in lines[t] if (host, x) not in gone)

    depleted = lambda t, host, gone: left(t, host, gone) < 20 or 100 * left(t, host, gone) < 10 * len(word.findall(t))
    first = frequent(lambda row, t: row)
    flagged = sorted({t for _, t, host in docs if any((host, x) in first for x, _ in lines[t]) and depleted(t, host, first)})
    group = groups_of(list(enumerate(flagged)), 5, 50)
    copies = {t: group[i] for i, t in enumerate(flagged)}
    gone = first & frequent(lambda row, t: ("copies", copies[t]) if t in copies else row)
    kept = []
    for i, t, host in docs:
        words = word.findall(t)
        windows = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and not depleted(t, host, gone):
            kept.append((i, "\n".join(x for x in t.split("\n") if (host, normal(x)) not in gone)))
    return sorted(kept)


def brute_mix(docs):
    """How often each doc_id is taken whole, in plain Python."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(i, t, s, len(word.findall(t))) for i, t, s in docs]
    sizes = {}
    for _, _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, taken = brute_targets(sizes, (5, 2, 1), 3), {}
    for source, size in sizes.items():
        key = lambda r: -math.log((int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / ((r[3] + 1) / (r[3] + 1 + sum(map(r[1].count, "#*$%&|<>"))))
        epochs, before = int(target[source] // size) if size else 0, 0
        budget = math.floor(target[source]) - epochs * size
        for r in sorted((r for r in rows if r[2] == source), key=key):
            taken[r[0]] = (epochs + (2 * before + r[3] <= 2 * budget)) if r[3] else 0
            before += r[3]
    return {i: n for i, n in taken.items() if n}


def test_each_stage_by_its_input(spark, sf_dir, tmp_path):
    """Each stage against its own version in plain Python; the trees' scores against their operator's."""
    docs, quality, clean, single, mixed, packed = (df.cache() for df in stages_of(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path))
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    for df in (quality, clean, single, mixed):
        assert df.columns == DOCUMENT
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
    assert sorted((i, t) for i, t, _ in rows(quality)) == brute_quality(rows(docs))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r["doc_id"] for r in toxic_documents(quality, labels).where("predicted = 1").collect()}
    assert sorted(rows(clean)) == sorted(r for r in rows(quality) if r[0] not in toxic)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    judged = [(i in toxic, truth[i] == 1) for i, _, _ in rows(quality) if i in truth]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)  # few labels at this size
    groups = groups_of([(i, t) for i, t, _ in rows(clean)], 5, 80)
    assert sorted(rows(single)) == sorted(r for r in rows(clean) if groups[r[0]] == r[0])
    assert Counter(i for i, _, _ in rows(mixed)) == brute_mix(rows(single))
    words = lambda t: len(t.split())
    found = packed.collect()
    assert Counter(i for i, _, _ in rows(mixed)) == Counter(r["doc_id"] for r in found if r["piece"] == 0)
    assert sum(r["n_words"] for r in found) == sum(words(t) for _, t, _ in rows(mixed))
    # One group: bins, sizes and starts are those of a scan over all bins.
    number = lambda values: {v: i for i, v in enumerate(sorted(values))}
    source, text = number({s for _, _, s in rows(mixed)}), number({t.lower() for _, t, _ in rows(mixed)})
    items = [(i, words(t), source[s], text[t.lower()]) for i, t, s in rows(mixed)]
    shape = lambda parts: sorted((n, start) for *_, n, _, start in parts)
    tails = [r for r in found if r["n_words"] % 2048]
    assert shape((r["doc_id"], r["piece"], r["n_words"], r["bin_id"], r["start"]) for r in tails) == shape(brute_packing(items, 2048))


def test_run_applies_all_stages(spark, sf_dir, tmp_path):
    *_, packed = stages_of(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path)
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.exceptAll(packed.select(*found.columns)).count() == 0 and found.count() == packed.count()


def test_one_of_many_edited_copies_in_a_host_survives(spark, make_docs, sf_dir):
    lines = [[f"line{i}word{j}" for j in range(12)] for i in range(12)]

    def edited(n):
        return "\n".join(" ".join(w if (i, j) != (n % 12, n // 12) else f"edit{n}" for j, w in enumerate(line)) for i, line in enumerate(lines))

    banner = "a banner that stands in all of the other pages"
    rows = [(n, edited(n), "s") for n in range(100)] + [(500 + n, banner + "\n" + " ".join(f"own{n}x{j}" for j in range(60)), "s") for n in range(30)]
    quality = corpus_pipeline.quality_rules(spark, make_docs(rows, clashing=True), sf_dir)
    texts = {r["doc_id"]: r["text"] for r in quality.collect()}
    assert [texts.get(n) for n in range(100)] == [edited(n) for n in range(100)]
    assert all(banner not in texts[500 + n] for n in range(30))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, quality, sf_dir).collect()}
    assert kept == {0} | set(range(500, 530))


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_odd_tables(spark, make_docs, sf_dir, i):
    name, stage = corpus_pipeline.STAGES[i]
    rng = random.Random(1)
    good = [(100 + n, " ".join(rng.choice(["of", "and", "then", "word", "text"]) + str(rng.randrange(90)) for _ in range(70)), "s") for n in range(20)]
    docs = make_docs(odd_rows() + good, clashing=True)
    found = stage(spark, docs, sf_dir)
    assert found.count() > 0
    if i + 1 < len(corpus_pipeline.STAGES):
        assert found.columns == docs.columns
    assert stage(spark, make_docs([]), sf_dir).count() == 0
