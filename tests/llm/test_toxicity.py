import math
import random
import re
import zlib

import pytest

from ledgerline.llm import toxicity
from ledgerline.llm.toxicity import FEATURES, HIT, NEAR, SECOND_PERSON, STRONG, Tokens, labelled_sample, terms, toxic_documents
from tests.llm.conftest import odd_rows

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=1):
    """Texts of invented words; a third of them insult with words that share a beginning."""
    rng = random.Random(seed)
    syllables = ["ra", "lo", "mi", "ten", "sol", "ved", "kun", "pa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 90))], i % 3 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), "grubzik" + rng.choice(syllables))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_texts_are_told_apart(spark, make_docs):
    rows, labels = corpus()
    found = toxic_documents(make_docs(rows, clashing=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in found if r["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_read(spark, make_docs):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [{r["doc_id"]: r["score"] for r in toxic_documents(make_docs(rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_the_sample_is_bounded_and_of_distinct_texts(spark, make_docs):
    rows, labels = corpus(600)
    rows += [(1000 + i, rows[0][1], "s") for i in range(50)]
    labels += [(1000 + i, 1, 1) for i in range(50)]
    assert labelled_sample(make_docs(rows), spark.createDataFrame(labels, LABELS), 200).count() <= 220
    whole = labelled_sample(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len({r["text"] for r in whole}) == len(whole)


def test_features():
    tokens = Tokens({"idiot$": 5.0, "moro": 2.0})
    f = dict(zip(FEATURES, tokens.features("You IDIOT! you moronic fool, id1ot i.d.i.o.t plain words"), strict=True))
    assert f["most"] == 5.0 and f["near_you"] == 1.0 and f["marks"] > 0 and f["capitals"] > 0
    assert f["obfuscated"] > 0 and f["obfuscated_hits"] == pytest.approx(1.0986, abs=1e-3)
    assert tokens.features(None) == tokens.features("") == [0.0] * len(FEATURES)
    assert terms("abcdef") == ["abcdef$", "abcd", "abcde"]


def recounted(text, lexicon):
    """The features by their definitions, token by token, for lexicons of whole words."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    words = [re.sub(r"^\W+|\W+$", "", t).lower() for t in tokens]
    weight, found = [], []
    for token, word in zip(tokens, words, strict=True):
        w = lexicon.get(word, 0.0)
        odd = word and re.search(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|(.)\1\1", token)
        forms = [re.sub(r"[\W_]+", "", "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}.get(c, c) for c in word)), re.sub(r"[\W_]+", "", word), re.sub(r"(.)\1\1+", r"\1", word)] if odd else []
        best = max([lexicon.get(f, 0.0) for f in forms if f != word], default=0.0)
        hidden = best > max(w, HIT)
        weight.append(best if hidden else w)
        found.append((bool(odd), hidden))
    n, hits, you = len(tokens), [i for i, w in enumerate(weight) if w >= HIT], [i for i, w in enumerate(words) if w in SECOND_PERSON]
    capitals = sum(t.isupper() and sum(c.isalpha() for c in t) > 2 for t in tokens)
    near = sum(any(abs(i - j) <= NEAR for j in you) for i in hits)
    strong, log = sum(w >= STRONG for w in weight), math.log1p
    return [
        log(n), log(len(hits)), len(hits) / n, log(strong), strong / n, sum(weight) / n, max(weight), log(len({tokens[i] for i in hits})), near / max(1, len(hits)), len(you) / n, capitals / n,
        (text.count("!") + text.count("?")) / n, sum(o for o, _ in found) / n, log(sum(h for _, h in found)),
    ]


def test_features_by_recounting():
    rng = random.Random(4)
    lexicon = {"idiot": 4.0, "moron": 2.0, "mild": 1.0, "fool": 3.5}
    tokens = Tokens({f"{w}$": v for w, v in lexicon.items()})
    pool = ["idiot", "IDIOT!", "id1ot", "i.d.i.o.t", "moron", "m0r0n", "fooool", "foool?", "mild", "You", "your", "plain", "WORDS", "A", "x9y", "don't", "«du»", "!!", "—", "aaa", "Ärger"]
    for _ in range(300):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert tokens.features(text) == pytest.approx(recounted(text, lexicon), abs=1e-6)


def test_a_fifth_of_each_label_calibrates(spark, make_docs):
    rows, labels = corpus(300)
    few = [(i, q, int(i in (1, 2))) for i, q, t in labels]
    sample = labelled_sample(make_docs(rows), spark.createDataFrame(few, LABELS)).collect()
    of = lambda toxic: [r["calibrates"] for r in sample if r["toxic"] == toxic]
    assert sum(of(1)) == 1 and len(of(1)) == 2 and abs(sum(of(0)) - len(of(0)) / 5) < 1


def test_a_label_with_one_row_leaves_scores_as_the_trees_give_them(spark, make_docs):
    rows, labels = corpus(120)
    only = next(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5)
    one = [(i, q, int(i == only)) for i, q, _ in labels]
    found = toxic_documents(make_docs(rows), spark.createDataFrame(one, LABELS)).collect()
    assert len(found) == 120 and all(0 <= r["score"] <= 1 for r in found)


def test_labels_with_few_rows_to_calibrate_stay_accurate(spark, make_docs):
    """Of one label 15 rows, three of which would calibrate."""
    rows, labels = corpus(400)
    known = [i for i, _, _ in labels if i % 3 == 0 and zlib.crc32(str(i).encode()) % 5][:15]
    few = [x for x in labels if x[2] == 0 or x[0] in known]
    found = toxic_documents(make_docs(rows), spark.createDataFrame(few, LABELS)).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in found) >= 0.95 * len(found)
    assert sum(r["predicted"] for r in found if r["doc_id"] % 3) <= 2


def test_scores_do_not_depend_on_partitions(spark, make_docs):
    rows, labels = corpus(300)
    scores = [{r["doc_id"]: r["score"] for r in toxic_documents(make_docs(rows).repartition(n), spark.createDataFrame(labels, LABELS).repartition(n)).collect()} for n in (1, 7)]
    assert scores[0] == scores[1]


def test_every_term_that_passes_is_in_the_lexicon(spark):
    many = " ".join(f"toxicword{i}" for i in range(9000))
    sample = spark.createDataFrame([(f"{many} end{i}", 1, i % 2) for i in range(6)] + [(f"calm words only {i}", 0, i % 2) for i in range(6)], "text string, toxic int, half int")
    assert sum(t.startswith("toxicword") and t.endswith("$") for t in toxicity.learn_lexicons(sample)[2]) == 9000


def test_odd_tables(spark, make_docs):
    rows = odd_rows()
    none = spark.createDataFrame([], LABELS)
    found = toxic_documents(make_docs(rows), none).collect()
    assert len(found) == len(rows) and {r["score"] for r in found} == {0.0}
    one_label = spark.createDataFrame([(i, 1, 1) for i in range(1, 10)] + [(None, 1, 0), (4, None, None)], LABELS)
    assert {r["predicted"] for r in toxic_documents(make_docs(rows), one_label).collect()} == {1}
    assert toxic_documents(make_docs([]), one_label).count() == 0
    learnt, labels = corpus(300)
    some = toxic_documents(make_docs(learnt + rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(some) == 300 + len(rows) and all(0 <= r["score"] <= 1 for r in some)
    assert all(r["held_out"] for r in some if r["doc_id"] is None)
