"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin holds one document of a source at most, and one of a cluster of
duplicates. Documents go in by descending size; bins are ordered by residual
and carry bitmaps of their sources and clusters. The search begins at the
least residual that a document fits in, and goes on to successors until it
finds the tightest bin without a conflict; failing that, a bin is opened.

Documents longer than a bin are cut into full pieces, a bin each, and a rest
that is packed. Documents are dealt by hash into groups of about `group_rows`,
each packed by one task from ids, sizes and hashes alone. A source or cluster with
a third of all rows is spread over all groups, and so are rows without doc_id and rows
that repeat one another, by a number that each of them has.

Null and empty texts are not packed: their bin is null. A very long text is cut like any other that is
longer than a bin. A null source is a source of its own. Rows that repeat one another are copies,
so no two of them share a bin. An empty table has no pieces. Extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, checkpointed, word_count
from ledgerline.llm.mixing import repeats

CAPACITY, GROUP_ROWS = 2048, 8192
#: Share of a group's documents from which on a source has an index of its own.
HOT_SHARE = 0.02


class Bins:
    """Open bins by residual, with an index of the residuals that some source's documents can use."""

    def __init__(self, capacity: int, hot_sources: list[int]):
        self.capacity = capacity
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bitmap of the residuals that have a bin
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []
        #: Of each hot source: bins without it at each residual, and the bitmap of where there are any.
        self.free = {s: [0] * (capacity + 1) for s in hot_sources}
        self.open = dict.fromkeys(hot_sources, 0)

    def _count(self, bin_: int, by: int) -> None:
        left, held = self.left[bin_], self.sources[bin_]
        for s, free in self.free.items():
            if not held >> s & 1:
                free[left] += by
                if free[left] == (by > 0):
                    self.open[s] ^= 1 << left

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The tightest bin that takes the document; of equals the one opened first. cluster: -1 if it can't conflict."""
        usable = self.open.get(source, self.used) >> size
        while usable:
            step = usable & -usable
            for bin_ in self.by_residual[size + step.bit_length() - 1]:
                if not self.sources[bin_] >> source & 1 and (cluster < 0 or not self.clusters[bin_] >> cluster & 1):
                    return bin_
            usable ^= step
        return None

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a document into a bin; the bin and where in it the document starts."""
        bin_ = self.find(size, source, cluster)
        if bin_ is None:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            left = self.left[bin_]
            self._count(bin_, -1)
            self.by_residual[left].remove(bin_)
            if not self.by_residual[left]:
                self.used ^= 1 << left
        start = self.capacity - self.left[bin_]
        self.left[bin_] -= size
        self.sources[bin_] |= 1 << source
        if cluster >= 0:
            self.clusters[bin_] |= 1 << cluster
        if left := self.left[bin_]:
            if not self.by_residual[left]:
                self.used |= 1 << left
            insort(self.by_residual[left], bin_)
            self._count(bin_, 1)
        return bin_, start


def pack(items: list[tuple[int | None, int, int, int]], capacity: int) -> list[tuple[int | None, int, int, int, int]]:
    """(doc_id, piece, words, bin, start) of every piece of (doc_id, size, source, cluster), size over 0."""
    pieces, packed = [], []
    for item in items:
        if item[1] % capacity:
            pieces.append(item)
    n_sources, n_clusters = Counter(x[2] for x in pieces), Counter(x[3] for x in pieces)
    source_of = {s: i for i, s in enumerate(sorted(n_sources))}
    cluster_of = {c: i for i, c in enumerate(sorted(c for c, n in n_clusters.items() if n > 1))}
    bins = Bins(capacity, [source_of[s] for s, n in n_sources.items() if n > HOT_SHARE * len(pieces)])
    # Ties in size go by doc_id, those without one first.
    order = lambda x: (-(x[1] % capacity), x[0] is not None, x[0] or 0, x[3], x[2])
    for doc_id, size, source, cluster in sorted(pieces, key=order):
        bin_, start = bins.add(size % capacity, source_of[source], cluster_of.get(cluster, -1))
        packed.append((doc_id, size // capacity, size % capacity, bin_, start))
    full = len(bins.left)
    for doc_id, size, _, _ in items:
        for piece in range(size // capacity):
            packed.append((doc_id, piece, capacity, full, 0))
            full += 1
    return packed


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, cluster: F.Column | None = None) -> DataFrame:
    """doc_id, piece, n_words, bin_id and start (words before it in its bin) of every piece of every row.

    `cluster` tells duplicates, such as a component of near copies; unless given, texts
    that are equal but for case are.
    """
    text = F.col("text").cast("string")
    cluster = F.xxhash64(F.lower(text)) if cluster is None else cluster
    rows = checkpointed(docs.select(F.col("doc_id").cast("long"), word_count(text).alias("size"), F.xxhash64(F.col("source").cast("string")).alias("source"), cluster.cast("long").alias("cluster")))
    groups = max(1, math.ceil(rows.count() / group_rows))

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        items = list(zip(*(group.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")), strict=True))
        found = list(zip(*pack(items, capacity), strict=True)) or [()] * 5
        first = key[0].as_py() << 32
        columns = [*found[:3], [first + b for b in found[3]], found[4]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "piece", "n_words", "bin_id", "start"])

    numbered = repeats(rows.where("size > 0").withColumn("key", F.xxhash64("doc_id", "cluster")), "key", ["size", "source"])
    group = F.pmod(F.xxhash64("key", "repeat"), F.lit(groups)).alias("group")
    pieces = numbered.select(group, "doc_id", "size", "source", "cluster").groupBy("group").applyInArrow(packed, "doc_id long, piece long, n_words long, bin_id long, start long")
    none = F.lit(None).cast("long")
    return pieces.union(rows.where("size = 0").select("doc_id", F.lit(0).cast("long"), "size", none, none))


def bin_texts(docs: DataFrame, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, n_words, doc_ids, text): the words of each bin's pieces in their places, one space between.

    doc_id has to be unique. A group is a bin, whose words are bounded by its capacity.
    """
    words = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)).alias("words"))
    cut = pieces.where("bin_id is not null").join(words, "doc_id").select("bin_id", "n_words", F.struct("start", "doc_id", F.array_join(F.slice("words", F.col("piece") * capacity + 1, F.col("n_words")), " ").alias("text")).alias("part"))
    bins = cut.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list("part")).alias("parts"))
    return bins.select("bin_id", "n_words", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"))
