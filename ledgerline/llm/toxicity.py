"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words, and beginnings of words, that labelled toxic texts
have far more often than others, each weighed by its smoothed log-odds.
Features are densities of its hits, how near they stand to words in the second
person, capitals, punctuation and obfuscation. Lexicons for the trees' training
rows come from the other half of the rows, so that the trees don't learn to
trust words which stand in a training text by chance.

Learning uses a sample of at most about `SAMPLE` labelled rows, drawn by hash
from the rows with crc32(doc_id as text) mod 5 other than 0; the lexicon has all terms of it
that pass the thresholds, so it is bounded by the sample. Label, language,
source and id of a text are never its features. Of each label's rows, in order of a hash, the second of every five
calibrates the trees. Steps of an isotonic curve that stand on a few rows are worse than none: where a label has fewer than
`LEAST_CALIBRATING` such rows, all go to the trees, and scores are the trees' own probabilities.
Rows are put in order before the trees see them, so that scores don't depend on the input's partitions.

Null and empty texts have features of 0 and a score like any other. With no
labelled rows, or rows of one label, the score is the share of that label.
Repeated rows are scored alike; a null doc_id is scored too and never learnt
from. A very long text is held by a task as the numbers of its tokens. An empty table gives an empty
result. Columns of the input stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import checkpointed, slices
from ledgerline.llm.mixing import running_total

#: Labelled rows to learn from, and in a task.
SAMPLE, TASK_ROWS = 20_000, 1024
FOLDS, HELD_OUT = 5, 0
#: One of so many rows calibrates; of either label there have to be so many that do.
CALIBRATES, LEAST_CALIBRATING = 5, 30
#: Lengths of the beginnings of words that are terms.
PREFIXES = (4, 5, 6, 7)
#: A term stands in so many toxic texts at least; log-odds of a hit, and of a strong one.
LEAST_TEXTS, HIT, STRONG = 3, 1.5, 3.0
#: Words between a hit and a word in the second person.
NEAR = 5
TREES, DEPTH, STEP = 20, 3, 0.25
#: Weight of the trees' own probability, which keeps order among equal calibrated scores.
ORDER_SHARE = 0.001

#: Words in the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner deines ihr euch euer eure tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
#: Characters that stand for letters in obfuscated words.
_LOOKALIKE = str.maketrans("013457@$!|€", "oieastasiie")
_EDGE = re.compile(r"^\W+|\W+$")
_INSIDE = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|(.)\1\1", re.UNICODE)
_LETTERS = re.compile(r"[\W_]+")
_CACHED = 1 << 18

FEATURES = ["words", "hits", "hit_density", "strong", "strong_density", "weight_density", "most", "distinct", "near_you", "you_density", "capitals", "marks", "obfuscated", "obfuscated_hits"]


def terms(word: str) -> list[str]:
    """The lexicon's entries that a word (lower case, no punctuation at its ends) can hit."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) > n)]


def plain(token: str) -> str:
    return _EDGE.sub("", token).lower()


class Tokens(dict):
    """Per raw token: row of its traits (weight, hit, strong, second person, capitals, obfuscated, obfuscated hit, term number)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows = lexicon, []
        self.traits = np.zeros((1024, 7), np.float32)

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0) if word else 0.0

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.traits):
            self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
        word = plain(token)
        weight, obfuscated, found = self.weight(word), False, False
        if word and _INSIDE.search(token):
            obfuscated = True
            for form in (_LETTERS.sub("", word.translate(_LOOKALIKE)), _LETTERS.sub("", word), re.sub(r"(.)\1\1+", r"\1", word)):
                if form != word and self.weight(form) > max(weight, HIT):
                    weight, found = self.weight(form), True
        letters = sum(map(str.isalpha, token))
        self.traits[n] = weight, weight >= HIT, weight >= STRONG, word in SECOND_PERSON, letters > 2 and token.isupper(), obfuscated, found
        self[token] = n
        return n

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > _CACHED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        traits = self.traits[at]
        total = traits.sum(0, dtype=np.float64)
        hits = np.flatnonzero(traits[:, 1])
        near = distinct = 0
        if len(hits):
            distinct = len(np.unique(at[hits]))
            you = np.flatnonzero(traits[:, 3])
            if len(you):
                after = np.clip(np.searchsorted(you, hits), 0, len(you) - 1)
                near = int((np.minimum(np.abs(you[after] - hits), np.abs(you[np.maximum(after - 1, 0)] - hits)) <= NEAR).sum())
        log = math.log1p
        marks = text.count("!") + text.count("?")
        return [
            log(n), log(len(hits)), len(hits) / n, log(total[2]), total[2] / n, total[0] / n, float(traits[:, 0].max()), log(distinct),
            near / max(1, len(hits)), total[3] / n, total[4] / n, marks / n, total[5] / n, log(total[6]),
        ]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text, mod 5, is 0. A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic, half, bits, calibrates) of at most about `most` labelled rows with distinct texts, written to the checkpoint folder."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20))
    drawn = known.where(draw < int((1 << 20) * min(1.0, 0.95 * most / max(1, known.count()))))
    # As many rows as the sample has at most, so their broadcast is bounded.
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    once = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumns({"bits": F.xxhash64("text", F.lit("half")), "one": F.lit(1)})
    drawn = checkpointed(once.withColumn("half", F.pmod("bits", F.lit(2)).cast("int")).coalesce(math.ceil(most / TASK_ROWS)))
    placed = running_total(drawn.select("toxic", "bits", "one"), ["toxic"], ["bits"], ["one"])
    # Texts whose 64 bits agree have one place, and so one part; no row is lost or doubled.
    placed = checkpointed(placed.groupBy("toxic", "bits").agg((F.min("before_one") % CALIBRATES == 1).alias("calibrates")).coalesce(1))
    # Few numbers of each row of the sample: broadcast, so that its texts aren't shuffled each time that it is read.
    return drawn.join(F.broadcast(placed), ["toxic", "bits"]).select("text", "toxic", "half", "bits", "calibrates")


def learn_lexicons(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Weights of terms from half 0, half 1, and both."""

    def count(batches):
        found: Counter = Counter()
        for batch in slices(batches):
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                for term in {t for word in {plain(x) for x in text.split()} if word for t in terms(word)}:
                    found[term, toxic, half] += 1
        if found:
            t, x, h = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(x, pa.int32()), pa.array(h, pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "toxic", "half", "n"])

    texts = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    per = [F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]
    counted = sample.mapInArrow(count, "term string, toxic int, half int, n long").groupBy("term").agg(*per)
    counted = counted.where(f"n01 + n11 >= {LEAST_TEXTS}")

    def odds(halves: tuple[int, ...]) -> Column:
        both = lambda t: sum(F.col(f"n{h}{t}") for h in halves)
        all_ = lambda t: sum(texts.get((h, t), 0) for h in halves)
        return F.log((both(1) + 0.5) / (all_(1) + 1)) - F.log((both(0) + 0.5) / (all_(0) + 1))

    weighed = counted.select("term", *[odds(h).alias(f"w{i}") for i, h in enumerate(((0,), (1,), (0, 1)))], *[F.col(f"n{h}1").alias(f"t{h}") for h in (0, 1)])
    # All that pass: each stands in some of the sample's toxic texts, so their number is bounded by the sample.
    kept = weighed.where("greatest(w0, w1, w2) >= 1").collect()
    half = lambda i: {r["term"]: r[f"w{i}"] for r in kept if r[f"w{i}"] >= 1 and r[f"t{i}"] >= min(2, LEAST_TEXTS)}
    return half(0), half(1), {r["term"]: r["w2"] for r in kept if r["w2"] >= 1}


def _with_features(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """(doc, vector): rows with their texts' features, by the lexicon that the column lexicon numbers.

    A row goes whole, as the column doc, so that no column of it can clash with ours.
    """

    def features(batches):
        tokens = [Tokens(x) for x in shared.value]
        for batch in slices(batches):
            texts = batch.column("doc").field("text").to_pylist()
            found = [tokens[i].features(t) for i, t in zip(batch.column("lexicon").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(pa.float64()))], ["doc", "features"])

    shared = rows.sparkSession.sparkContext.broadcast(lexicons)
    schema = rows.select("doc").schema.add("features", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(features, schema).select("doc", array_to_vector("features").alias("vector"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, score): each row of `docs` whole, and 0 to 1, higher where label 1 is likelier."""
    whole = docs.select(F.struct("*").alias("doc"), F.lit(0).alias("lexicon"))
    rows = labelled_sample(docs, labels, sample)
    rate = rows.agg(F.avg("toxic")).first()[0]
    if rate in (None, 0.0, 1.0):
        return whole.select("doc", F.lit(float(rate or 0)).alias("score"))
    *halves, full = learn_lexicons(rows)
    training = rows.select(F.struct("*").alias("doc"), (1 - F.col("half")).alias("lexicon"))
    enough = rows.where("calibrates").agg(F.least(F.sum("toxic"), F.sum(1 - F.col("toxic")))).first()[0] or 0
    calibrates = F.col("doc.calibrates") & F.lit(enough >= LEAST_CALIBRATING)
    featured = _with_features(training, halves).select(F.col("doc.toxic").cast("double").alias("toxic"), calibrates.alias("calibrates"), "doc.bits", "doc.text", "vector")
    # As many rows as the sample has, each of a few numbers, in one order whatever the partitions are.
    learn = checkpointed(featured.withColumn("tie", F.xxhash64("text")).drop("text").repartition(1).sortWithinPartitions("bits", "tie").select("toxic", "calibrates", "vector"))
    trees = GBTClassifier(featuresCol="vector", labelCol="toxic", predictionCol="prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1)
    model = trees.setRawPredictionCol("raw").setProbabilityCol("probability").fit(learn.where("not calibrates"))

    def with_probability(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("p", vector_to_array("probability")[1])

    calibration = with_probability(learn.where("calibrates")).select("toxic", "p")
    isotonic = None
    if enough >= LEAST_CALIBRATING:
        isotonic = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="calibrated").fit(calibration)
    scored = with_probability(_with_features(whole, [full]))
    scored = isotonic.transform(scored) if isotonic else scored.withColumn("calibrated", F.col("p"))
    return scored.select("doc", ((1 - ORDER_SHARE) * F.col("calibrated") + ORDER_SHARE * F.col("p")).alias("score"))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = toxicity_scores(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels).select("doc.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
