"""Document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so that a repeated
k-mer counts as often as it stands there. Each of `hashes` functions selects the
`TUPLE` least numbered k-mers; these keep their order in the text, and the hash
of that tuple is one component of the signature. Moving text about changes the
order within tuples, so the share of equal components follows edit distance and
not just the set of k-mers.

Null texts count as empty. An empty text has one k-mer of its own, and a text
shorter than a k-mer is its own single k-mer. Of a very long text some thousand k-mers are
hashed by all functions at a time. Rows without doc_id and rows that repeat one another have
fingerprints like others; an empty table has none. Extra columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, mixed, shuffle_partitions, slices

#: Code points of a k-mer (a power of two), k-mers of a tuple, functions.
KMER, TUPLE, HASHES = 8, 2, 64
#: K-mers that are hashed by all functions at a time.
_BLOCK = 4096
#: Ranges of doc_id for each shuffle partition, so that partitions come out even.
_RANGES = 4
#: Rows that are alike in doc_id and text are dealt apart from so many on, if they'd fill a range.
_LEAST_HOT = 64
_OUTPUT_ROWS = 1024
_KEY = "decimal(38,0)"


class OrderMinHash:
    """Signatures of texts: arrays of `hashes` 32-bit components."""

    def __init__(self, hashes: int = HASHES, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, (hashes, 1), np.uint32)
        self.factor = rng.integers(0, 1 << 32, (hashes, 1), np.uint32) | np.uint32(1)
        self.steps = [np.uint64(x) | np.uint64(1) for x in rng.integers(0, 1 << 63, 8, np.uint64)]
        self.rows = np.arange(hashes)

    def elements(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Occurrence-numbered k-mer hashes, and where each stands."""
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(h) < KMER:
            powers = np.cumprod(np.full(len(h), self.steps[0]))
            return mixed(np.array([(h * powers).sum(dtype=np.uint64) + np.uint64(len(h))])), np.zeros(1, np.int64)
        width, step = 1, 0
        while width < KMER:
            h = h[:-width] * self.steps[step] + h[width:]
            width, step = 2 * width, step + 1
        h = mixed(h)
        n = len(h)
        bits = np.uint64(max(1, int(n).bit_length()))
        # The hash's upper bits with the position below them: one sort groups equal k-mers in text order.
        packed = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
        group, at = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        same = group[1:] == group[:-1]
        h = h[at]
        if same.any():
            index = np.arange(n)
            begin = np.maximum.accumulate(np.where(np.r_[True, ~same], index, 0))
            h = h + mixed((index - begin).astype(np.uint64)) * (index > begin)
        return h, at

    def signature(self, text: str) -> np.ndarray:
        h, at = self.elements(text)
        x = (mixed(h) >> np.uint64(32)).astype(np.uint32)
        picks, values = [], []
        for start in range(0, len(x), _BLOCK):
            y = (x[start : start + _BLOCK] ^ self.flip) * self.factor
            for _ in range(min(TUPLE, y.shape[1])):
                i = y.argmin(1)
                picks.append(i + start)
                values.append(y[self.rows, i])
                y[self.rows, i] = 0xFFFFFFFF
        picks, values = np.array(picks), np.array(values)
        if len(picks) > TUPLE:
            best = np.argsort(values, 0, kind="stable")[:TUPLE]
            picks = np.take_along_axis(picks, best, 0)
        picks = np.take_along_axis(picks, np.argsort(at[picks], 0, kind="stable"), 0)
        total = np.zeros(len(self.rows), np.uint64)
        for row in h[picks]:
            total = mixed(total + row)
        return (total >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components, 0 to 1."""
    return float((a == b).mean())


def _text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): keys are in order of doc_id, those without one last, and then of 60 bits of the text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 4).cast("decimal(19,0)")
    return rows.withColumn("key", (place * F.lit(str(1 << 60)).cast("decimal(19,0)") + tie).cast(_KEY))


def _keys(values: list[Decimal]) -> F.Column:
    """An array of keys, as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{_KEY}>")


def _with_successors(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(range, ahead, doc_id, text), sorted so that a document's successor follows it; and rows (doc_id, text, part) whose successor is a row like themselves.

    Documents are dealt by ranges of their key. The first document of a range is also
    the last one of the range before it, flagged `ahead`; the first of all closes the last range.

    Rows with a key that alone would fill a range have one row in its range, which comes last of
    them; the others follow one another and are told apart by `rows` and `part`.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = _ordered(docs)
    # Ranges of keys alone, each of which begins with a key that is there.
    keys = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")))
    ranges = checkpointed(keys.repartitionByRange(n * _RANGES, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("first"), F.sum("n").alias("n")))
    starts = sorted(r["first"] for r in ranges.collect()) or [Decimal(0)]
    total = ranges.agg(F.sum("n")).first()[0] or 0
    # Fewer keys than there are ranges.
    hot = [r["key"] for r in keys.where(F.col("n") * (n * _RANGES) > F.lit(max(total, n * _RANGES * _LEAST_HOT))).select("key").collect()]
    # A row looks into every so many of the starts, and then between two of those.
    step = math.isqrt(len(starts))
    below = lambda array: F.size(F.filter(array, lambda x: x <= F.col("key")))
    skipped = F.greatest(F.lit(0), below(_keys(starts[::step])) - 1) * step
    own = F.col("skipped") + below(F.slice(_keys(starts), F.col("skipped") + 1, F.lit(step))) - 1
    repeats = None
    if hot:
        alike = F.array_contains(_keys(hot), F.col("key"))
        # Combined before the shuffle: a task has a row for each of these keys at most.
        combined = checkpointed(rows.where(alike).groupBy("key", "doc_id", "text").agg(F.count("*").alias("n")))
        rows = rows.where(~alike).unionByName(combined.drop("n"))
        parts = F.explode(F.expr(f"sequence(0L, (n - 2) div {_OUTPUT_ROWS})")).alias("part")
        repeats = combined.where("n > 1").select("doc_id", "text", "n", parts)
        repeats = repeats.select("doc_id", "text", F.expr(f"least({_OUTPUT_ROWS}L, n - 1 - part * {_OUTPUT_ROWS})").alias("rows")).repartition(n)
    turns = F.expr("array(struct(own as range, false as ahead))")
    before = F.expr(f"array(struct(own as range, false as ahead), struct(if(own = 0, {len(starts) - 1}, own - 1) as range, true as ahead))")
    dealt = rows.withColumn("skipped", skipped).withColumn("own", own).withColumn("turn", F.explode(F.when(F.get(_keys(starts), F.col("own")) == F.col("key"), before).otherwise(turns)))
    sorted_ = dealt.select("turn.range", "turn.ahead", "key", "doc_id", "text").repartition(n, "range").sortWithinPartitions("range", "ahead", "key", "text")
    return sorted_.select("range", "ahead", "doc_id", "text"), repeats


def order_minhash(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(doc_id, fingerprint): the signature of each document's whole text, in hexadecimal."""

    def signatures(batches):
        minhash = OrderMinHash(hashes)
        for batch in slices(batches):
            found = [_text_of(minhash.signature(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(signatures, "doc_id long, fingerprint string")


def edit_likeness(docs: DataFrame, share: int = 4, hashes: int = HASHES) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of its successor.

    The last 1/`share` of a text's code points give way to the first as many of
    the successor's by doc_id (ties: by a hash of the text; no doc_id: last; after the last
    document comes the first). Rows stream through sorted ranges; a task holds
    one document and its successor at a time. Of rows that repeat one another, each is followed by
    the next of them; where these are very many, they are worked on in parts.
    """

    def compare(minhash: OrderMinHash, doc_id: int, text: str, signature: np.ndarray, next_text: str, next_signature: np.ndarray) -> tuple:
        cut = len(text) // share
        edited = text[: len(text) - cut] + next_text[:cut]
        changed = minhash.signature(edited) if cut else signature
        return doc_id, len(text), sha256(edited.encode()).hexdigest(), _text_of(signature), _text_of(changed), likeness(signature, changed), likeness(signature, next_signature)

    def compared(batches):
        minhash = OrderMinHash(hashes)
        waiting, out = None, []
        for batch in slices(batches):
            for rng, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                signature = minhash.signature(text)
                if waiting is not None and waiting[0] == rng:
                    out.append(compare(minhash, *waiting[1:], text, signature))
                waiting = None if ahead else (rng, doc_id, text, signature)
                if len(out) >= _OUTPUT_ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def alike(batches):
        minhash = OrderMinHash(hashes)
        for batch in slices(batches):
            for doc_id, text, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                signature = minhash.signature(text)
                yield batch_of([compare(minhash, doc_id, text, signature, text, signature)] * rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows, repeats = _with_successors(docs)
    found = rows.mapInArrow(compared, schema)
    return found if repeats is None else found.union(repeats.mapInArrow(alike, schema))

