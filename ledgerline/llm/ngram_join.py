"""N-gram Jaccard join of documents: a size-aware heavy-light join.

Two documents link when the Jaccard similarity of their word-shingle sets
reaches a threshold. The join is exact and works in four steps.

1. Every text becomes a set of 64-bit shingle hashes; equal sets form one
   class, so copies are never paired with one another.
2. Sets are divided by size, with a boundary where enumeration would begin to cost
   more than a set share of what the lists cost, by the number of sets of each size.
   * Light: a small set enumerates all its subsets of the fixed size that its
     larger partner, of s elements, asks for: two sets link only if they share a subset of
     the percent * s / 100 elements that the smaller one has at least.
   * Heavy: large sets go into inverted lists. Elements are dealt by hash into
     one part more than two sets of a size class can differ in, so that a part at
     least is untouched if they link, and lists are keyed by the content of a part.
     Lists of single shingles would hold every document with a frequent passage;
     lists of parts hold little but near copies. Frequent shingles, counted over
     all documents, are left out of the parts where enough others are there, and so are
     parts of a single shingle: texts that have nothing but a common phrase in common
     would meet there, more of them the more documents there are.
3. Sets that meet under a key are put in one block (stars to the least set of
   the key, then connected components), never expanded into pairs.
4. In each block the inverted lists of single shingles are scanned for each set, and overlaps
   counted exactly. Blocks beyond a fixed size, or number of sets, are cut into chunks, and every pair
   of chunks is a task of its own, so no block needs one task. A text goes to
   as many tasks as its block has chunks; what that costs is less than the
   counting, which looks at all pairs of a block's different sets, for their links are asked for.

Null and empty texts have an empty set, which links with nothing. Texts with
fewer words than a shingle have the whole sequence as their one shingle; very long
texts are sets like any other. Rows that share a doc_id are one node: their links unite. Rows without
doc_id take part, and have the component_id of the documents that they link with,
null if none of these has an id. Repeated rows are rows of their own, and link. An empty
table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WordHashes, as_bytes, checkpointed, mixed, shuffle_partitions, signed, slices, text_hashes
from ledgerline.llm.components import connected_components

#: Sizes of one class differ by this factor at most.
CLASS_RATIO = 1.26
#: Rows that enumeration may cost, as a share of the rows that the lists cost.
LIGHT_SHARE = 0.25
#: Standard deviations by which the expected number of parts of two elements exceeds what sets can differ in, at least, for lists to be made of such parts.
PAIRED_LEAST = 1
#: A shingle is frequent in a chunk of documents (so many shingles) from this share, and number, of them on.
COUNTED_SHINGLES, FREQUENT_SHARE, FREQUENT_LEAST = 1 << 21, 0.001, 8
#: Frequent shingles that are broadcast at most (8 bytes each). Which they are changes the cost, never the result.
FREQUENT = 1 << 20
#: Shingles, and sets, that a task takes in one block or chunk, and shingles in all blocks that it takes together.
BLOCK_SHINGLES, BLOCK_SETS, UNIT_SHINGLES = 1 << 20, 1 << 8, 1 << 19
#: Bytes of text that are worked on together in a task.
CHUNK_BYTES = 2 << 20
#: Rows of signatures in a reducing task.
TASK_ROWS = 1 << 20
#: Subsets' hashes that are made at a time.
SUBSETS_AT_ONCE = 1 << 20
#: Bits of the filter that keeps most texts out of the last shuffle.
FILTER_BITS = 1 << 23

_SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    parts = min(n, width)
    total = np.full(n - parts + 1, parts, np.uint64)
    for i in range(parts):
        total = mixed(total + h[i : n - parts + 1 + i])
    return np.unique(total)


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on a set's elements alone."""
    with np.errstate(over="ignore"):
        return tuple(int(mixed(s ^ salt).sum(dtype=np.uint64).view(np.int64)) for salt in _SALTS[:2])


class SizeClass(NamedTuple):
    """Sets of `least` to `most` elements: how many two that link can differ in, the parts of their lists, and the subsets that one may enumerate.

    fill: elements that a part needs to be a key, where enough parts have them. keys: about as many as a set has in its class.
    """

    least: int
    most: int
    differ: int
    parts: int
    subsets: int
    fill: int
    keys: int


def least_partner(size: int, percent: int) -> int:
    """The size of the smallest set that can link with one of `size`; they have as many elements in common at least."""
    return -(-percent * size // 100)


def class_bounds(largest: int, percent: int) -> list[int]:
    """Least size of each class, up to one beyond `largest`. Below the first, sets link only if equal; at 100 percent all do."""
    if percent >= 100:
        return [largest + 1]
    first = -(-percent // (100 - percent))
    bounds = [first]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * max(CLASS_RATIO, 100 / percent + 0.01))))
    return bounds


def _parts(k: int, least: int) -> int:
    """Parts of which k differences leave one untouched, and of which sets of `least` elements nearly always fill more than k."""
    n = k + 1
    while n < 4 * (k + 1):
        empty = n * math.exp(-least / n)
        if n - empty - 3 * math.sqrt(empty) >= k + 1:
            break
        n += 1 + n // 100
    return n


def _most_differ(sizes: np.ndarray, most: int, percent: int) -> np.ndarray:
    """How many elements sets of such sizes can differ in from any that they link with, of up to `most` elements."""
    return (100 - percent) * (sizes + np.minimum(most, 100 * sizes // percent)) // (100 + percent)


def _paired_parts(k: int, least: int, most: int, percent: int) -> tuple[int, int] | None:
    """Parts of which sets of `least` to `most` elements nearly always have more with two elements or more than they can differ in, and about how many those are; None if there is no such number."""
    sizes = np.unique(np.linspace(least, most, 6).astype(np.int64))
    differ = _most_differ(sizes, most, percent)
    best, n = (PAIRED_LEAST, None), k + 1
    while n < 4 * (k + 1):
        share = 1 - np.exp(-sizes / n) * (1 + sizes / n)
        margin = ((n * share - differ - 1) / np.sqrt(n * share * (1 - share) + 1e-9)).min()
        if margin >= best[0]:
            best = margin, (n, math.ceil(n * share[-1]))
        if margin >= 3:
            break
        n += 1 + n // 100
    return best[1]


def _subsets(size: int, dropped: int) -> int:
    """Subsets of a set that lack so many elements at most; counted no further than where nobody would enumerate them."""
    total = 0
    for i in range(dropped + 1):
        total += math.comb(size, i)
        if total > 1 << 40:
            break
    return total


def class_plan(bounds: list[int], percent: int) -> list[SizeClass]:
    plan = []
    for least, above in zip(bounds[:-1], bounds[1:], strict=True):
        k = 2 * (above - 1) * (100 - percent) // (100 + percent)
        # Sets of the class before, of its greatest sizes, are dealt into these parts too.
        parts = _parts(k, least_partner(least, percent))
        paired = _paired_parts(k, least_partner(least, percent), above - 1, percent)
        fill, parts, keys = (2, *paired) if paired else (1, parts, parts)
        plan.append(SizeClass(least, above - 1, k, parts, _subsets(above - 1, above - 1 - least_partner(above - 1, percent)), fill, keys))
    return plan


def light_classes(counts: dict[int, int], plan: list[SizeClass]) -> int:
    """How many of the classes, from the smallest on, are enumerated."""
    heavy = sum(n * plan[g].keys for g, n in counts.items())
    light = 0
    for g, c in enumerate(plan):
        light += counts.get(g, 0) * c.subsets
        heavy -= counts.get(g, 0) * c.keys
        if light > LIGHT_SHARE * heavy:
            return g
    return len(plan)


@lru_cache(maxsize=512)
def _chosen(size: int, dropped: int) -> np.ndarray:
    """All choices of elements to leave out of a set, one a row."""
    return np.array(list(combinations(range(size), dropped)), np.intp).reshape(math.comb(size, dropped), dropped)


def _subset_keys(sets: list[np.ndarray], nodes: np.ndarray, percent: int, largest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the subsets of small sets, by the sizes that partners of up to `largest` elements ask for; sets of one size."""
    size = len(sets[0])
    elements = mixed(np.array(sets) ^ _SALTS[2])
    whole = elements.sum(1, dtype=np.uint64)
    keys, out = [], []
    for asked in sorted({least_partner(s, percent) for s in range(size, min(largest, 100 * size // percent) + 1)}):
        left_out = _chosen(size, size - asked)
        step = max(1, SUBSETS_AT_ONCE // (len(left_out) * max(1, size - asked)))
        for i in range(0, len(sets), step):
            # A subset's hash depends on its elements alone: their sum.
            found = whole[i : i + step, None] - elements[i : i + step][:, left_out].sum(2, dtype=np.uint64)
            keys.append(mixed(found + np.uint64(asked * int(_SALTS[4]) % (1 << 64))).ravel())
            out.append(np.repeat(nodes[i : i + step], len(left_out)))
    return keys, out


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which elements are in a sorted list."""
    if not len(listed):
        return np.zeros(len(x), bool)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x


def _part_keys(sets: list[np.ndarray], differ: np.ndarray, g: int, plan: list[SizeClass], realm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of sets in class g, which of them to use, and which sets have too few filled parts. differ: what each can differ in from those that it links with."""
    n, m = plan[g].parts, len(sets)
    elements = mixed(np.concatenate(sets) ^ _SALTS[2])
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    cell = doc * n + ((elements >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    elements = mixed(elements ^ _SALTS[3])
    low = np.bincount(cell, (elements & np.uint64(0xFFFFFFFF)).astype(np.float64), m * n).astype(np.uint64)
    high = np.bincount(cell, (elements >> np.uint64(32)).astype(np.float64), m * n).astype(np.uint64)
    content = (low + (high << np.uint64(32))).reshape(m, n)
    held = np.bincount(cell, minlength=m * n).reshape(m, n)
    content = mixed(content + (np.arange(n, dtype=np.uint64) * _SALTS[4] + np.uint64(2 * g + realm)))
    # With more parts of `fill` elements than differences, an untouched one has as many on both sides; else, with more filled ones, it has content.
    filled, use = held > 0, held >= plan[g].fill
    use |= filled & (use.sum(1) <= differ)[:, None]
    return content, use, filled.sum(1) <= differ


def _signatures(sets: list[np.ndarray], nodes: np.ndarray, bounds: list[int], plan: list[SizeClass], light: int, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of every set: subsets for its light partners, lists for its heavy ones.

    A pair is found by the class of its larger set. So a set has keys for its own
    class and, near the class's end, for the next, which may be a heavy one
    while its own is light.

    Lists' keys are made of a set's elements that aren't frequent: two sets differ in no
    more of those than of all. Of two sets that link, if one has more parts with `fill` of them
    than they can differ in, an untouched one of these is the other's too. A set that has fewer
    has keys of all parts that it fills, for partners that do as well. A set that fills too few even so
    has keys of all its elements besides; and if even these fill too few parts, keys of its empty parts.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(bounds, sizes, side="right") - 1
    keys, out = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    ends = np.array(bounds, np.int64)
    largest = plan[light - 1].most if light else 0
    for size in np.unique(sizes[(own >= 0) & (own < light)]):
        at = np.flatnonzero(sizes == size)
        found = _subset_keys([sets[i] for i in at], nodes[at], percent, largest)
        keys += found[0]
        out += found[1]
    for step in (0, 1):
        goes = own >= 0
        if step:
            goes &= 100 * sizes >= percent * ends[np.minimum(own + 1, len(ends) - 1)]
        for g in np.unique(own[goes]):
            at = np.flatnonzero(goes & (own == g))
            g = int(g) + step
            if not light <= g < len(plan):
                continue
            rare = [sets[i][~_among(sets[i], frequent)] for i in at]
            differ = _most_differ(sizes[at], plan[g].most, percent)
            key, use, sparse = _part_keys(rare, differ, g, plan, 0)
            keys.append(key[use])
            out.append(np.repeat(nodes[at], use.sum(1)))
            if sparse.any():
                at, differ = at[sparse], differ[sparse]
                key, use, sparse = _part_keys([sets[i] for i in at], differ, g, plan, 1)
                use |= sparse[:, None]
                keys.append(key[use])
                out.append(np.repeat(nodes[at], use.sum(1)))
    return np.concatenate(keys), np.concatenate(out)


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its least node, and the distinct (least, other) pairs of nodes that share a key."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.r_[True, key[1:] != key[:-1]]
    least = node[first][np.cumsum(first) - 1]
    differ = least != node
    a, b = least[differ], node[differ]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return key[first], node[first], a[new], b[new]


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, h1, h2, frequent): hashes of each document's text, size and digest of its set; where frequent, a shingle h1 and how many documents of a chunk have it."""

    def digests(batches):
        hashes = WordHashes()
        held, total = [], 0
        for batch in slices(batches):
            rows = []
            for text in as_bytes(batch.column("text")):
                s = shingles(text, width, hashes)
                rows.append((len(s), *_digest(s)))
                if len(s):
                    held.append(s)
                    total += len(s)
                if total >= COUNTED_SHINGLES:
                    yield often(held)
                    held, total = [], 0
            n, h1, h2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch_of([batch.column(c) for c in ("doc_id", "t1", "t2")], n, h1, h2, False)
        if held:
            yield often(held)

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        frequent = counts >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(sets))
        found, counts = found[frequent].view(np.int64), counts[frequent]
        return batch_of([pa.nulls(len(found), pa.int64())] * 3, counts, found, np.zeros(len(found), np.int64), True)

    def batch_of(row: list[pa.Array], n, h1, h2, frequent: bool) -> pa.RecordBatch:
        columns = [*row, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([frequent] * len(n), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "t1", "t2", "n_shingles", "h1", "h2", "frequent"])

    text = F.col("text").cast("string")
    t1, t2 = text_hashes(text)
    return docs.select(F.col("doc_id").cast("long"), t1.alias("t1"), t2.alias("t2"), text.alias("text")).mapInArrow(digests, "doc_id long, t1 long, t2 long, n_shingles long, h1 long, h2 long, frequent boolean")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles that are frequent in chunks of documents, sorted; `FREQUENT` of them at most, those with the most documents."""
    counted = sets.where("frequent").groupBy("h1").agg(F.sum("n_shingles").alias("n"))
    found = counted.orderBy(F.desc("n"), "h1").limit(FREQUENT).select("h1").toPandas()["h1"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def candidate_edges(docs: DataFrame, width: int, percent: int, bounds: list[int], light: int, frequent: np.ndarray, tasks: int) -> DataFrame:
    """(a, b): stars over sets (by h1) that share a signature; a superset's components hold all links."""
    plan = class_plan(bounds, percent)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def signatures(distinct: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of all sets; so many at a time that what is made on the way stays small."""
        nodes, sets = np.fromiter(distinct, np.int64, len(distinct)), list(distinct.values())
        of = np.searchsorted(bounds, [len(s) for s in sets], side="right") - 1
        made = np.cumsum([plan[g].subsets if g < light else 2 * plan[g].parts for g in of]) // SUBSETS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(made)) + 1), len(sets)]
        found = [_signatures(sets[i:j], nodes[i:j], bounds, plan, light, percent, shared.value) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def postings(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            for start, end in _chunks(texts):
                distinct = {}
                for text in texts[start:end]:
                    s = shingles(text, width, hashes)
                    if len(s) >= bounds[0]:
                        distinct[_digest(s)[0]] = s
                if not distinct:
                    continue
                key, node, a, b = _stars(*signatures(distinct))
                # Sets that met here already go on as pairs with a key of their own,
                # so a key of many sets costs the shuffle one row for each chunk.
                pair = mixed(mixed(a.view(np.uint64) ^ _SALTS[0]) + b.view(np.uint64))
                keys, all_nodes = np.concatenate([key, pair, pair]), np.concatenate([node, a, b])
                for i in range(0, len(keys), 1 << 18):
                    yield pa.RecordBatch.from_arrays([signed(keys[i : i + (1 << 18)]), pa.array(all_nodes[i : i + (1 << 18)])], ["key", "node"])

    def meet(batches):
        parts = [(b.column("key").to_numpy(), b.column("node").to_numpy()) for b in batches if b.num_rows]
        if parts:
            _, _, a, b = _stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    posted = docs.select(F.col("text").cast("string")).mapInArrow(postings, "key long, node long")
    return posted.repartition(tasks, "key").mapInArrow(meet, "a long, b long")


def block_links(rows: pa.Table, width: int, percent: int) -> pa.Table:
    """Links within the blocks of one task: spanning edges (a, b, 0) and counts (a, null, links).

    A row has node (its class), text, block, copies (rows of its class) and side: 0 and 1
    of a pair of chunks that are counted against one another, null of a chunk
    (or whole block) that is counted against itself.
    """
    hashes = WordHashes()
    block = rows.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    copies = rows.column("copies").to_numpy()[order]
    side = rows.column("side").fill_null(-1).to_numpy()[order]
    texts = as_bytes(rows.column("text").combine_chunks())
    cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True])
    out_a, out_b, out_links = [], [], []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        sets = [shingles(texts[i], width, hashes) for i in order[start:end]]
        m, sizes = len(sets), np.array([len(s) for s in sets])
        elements, which = np.unique(np.concatenate(sets), return_inverse=True)
        del sets
        which = which.astype(np.int32)
        lists = np.bincount(which, minlength=len(elements)).astype(np.int32)
        doc = np.repeat(np.arange(m, dtype=np.int32), sizes)
        shared = lists[which] > 1
        which, doc = which[shared], doc[shared]
        by_element = np.argsort(which, kind="stable")
        posted, begins = doc[by_element], np.r_[0, np.cumsum(np.bincount(which, minlength=len(elements)))]
        begin_of = np.r_[0, np.cumsum(np.bincount(doc, minlength=m))]
        label, links = np.arange(m), np.zeros(m, np.int64)
        for x in range(m - 1):
            scanned = which[begin_of[x] : begin_of[x + 1]]
            if not len(scanned):
                continue
            lengths = begins[scanned + 1] - begins[scanned]
            at = np.repeat((begins[scanned] - np.r_[0, np.cumsum(lengths)[:-1]]).astype(np.int32), lengths)
            at += np.arange(len(at), dtype=np.int32)
            common = np.bincount(posted[at], minlength=m)[x + 1 :]
            linked = 100 * common >= percent * (sizes[x] + sizes[x + 1 :] - common)
            sides = side[start + x + 1 : end]
            linked &= (sides != side[start + x]) | (sides < 0)
            y = np.flatnonzero(linked) + x + 1
            if not len(y):
                continue
            links[x] += copies[start + y].sum()
            links[y] += copies[start + x]
            for l, one in zip(*np.unique(label[y], return_index=True), strict=True):
                if l != label[x]:
                    out_a.append(order[start + x])
                    out_b.append(order[start + y[one]])
                    out_links.append(0)
                    label[label == l] = label[x]
        for x in np.flatnonzero(links):
            out_a.append(order[start + x])
            out_b.append(None)
            out_links.append(links[x])
    nodes = rows.column("node").combine_chunks()
    return pa.table({"a": nodes.take(pa.array(out_a, pa.int64())), "b": nodes.take(pa.array(out_b, pa.int64())), "links": pa.array(out_links, pa.int64())})


def _row_hash(doc_id: F.Column, t1: F.Column, t2: F.Column) -> F.Column:
    return F.xxhash64(doc_id, doc_id.isNull(), t1, t2)


def flagged(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, t1, t2, possible): each row of `docs` whole, its text's hashes, and false where it is not among `rows` (doc_id, t1, t2), true of the others and a few more.

    A filter of fixed size over `rows` is broadcast: 64-bit words, one bit for each row.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    position = lambda *row: F.pmod(_row_hash(*row), F.lit(FILTER_BITS))
    words = rows.select(position(*map(F.col, ("doc_id", "t1", "t2"))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    t1, t2 = text_hashes(F.col("doc.text").cast("string"))
    whole = docs.select(F.struct("*").alias("doc")).select("doc", t1.alias("t1"), t2.alias("t2"))
    at = position(F.col("doc.doc_id").cast("long"), F.col("t1"), F.col("t2"))
    probed = whole.join(F.broadcast(words), F.shiftright(at, 6) == F.col("word"), "left")
    return probed.select("doc", "t1", "t2", F.coalesce(F.col("bits").bitwiseAND(bit(at)) != 0, F.lit(False)).alias("possible"))


#: Nodes of the graph are doc_ids; classes in which no row has one come after all of them.
_BEYOND, _NODE = 1 << 63, "decimal(20,0)"


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, by_id: bool = True) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_shingles, component_id, class_id, n_links, node and component of every row, and whether it is the row that stands for its component.

    A node is a class of rows with equal sets; a component of nodes tells rows
    apart that have no doc_id too. The row that stands for a component is the first by
    doc_id, then text, of the class that the component is named for; rows that repeat it do too.

    Rows that share a doc_id are one document with `by_id`, and unite their links; without, only texts
    count, and a class whose first doc_id has other texts too is named like one without.
    """
    spark = docs.sparkSession
    counted = checkpointed(shingle_sets(docs, width))
    sets = counted.where("not frequent").drop("frequent")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first")
    beyond = F.col("h1").cast(_NODE) + F.lit(str(2 * _BEYOND)).cast(_NODE)
    node = F.when(F.col("first.no_id"), beyond).otherwise(F.col("first.doc_id")).cast(_NODE)
    classes = sets.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(first, F.count("*").alias("copies"))
    known = sets.where("n_shingles > 0 and doc_id is not null")
    several = checkpointed(known.groupBy("doc_id").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("doc_id"))
    united = not several.isEmpty()
    if united and not by_id:
        classes = classes.join(several.select(F.col("doc_id").alias("shared")), F.col("first.doc_id") == F.col("shared"), "left")
        node = F.when(F.col("shared").isNull(), node).otherwise(beyond).cast(_NODE)
    classes = checkpointed(classes.select("n_shingles", "h1", "h2", "copies", "first.doc_id", "first.t1", "first.t2", node.alias("node")))
    largest = classes.agg(F.max("n_shingles")).first()[0] or 0
    bounds = class_bounds(largest, percent)
    plan = class_plan(bounds, percent)
    # One row for each size class; their number is the logarithm of the largest size.
    group = F.expr("size(filter(array({}), x -> x <= n_shingles)) - 1".format(", ".join(f"{b}L" for b in bounds)))
    counts = {r["g"]: r["n"] for r in classes.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect() if 0 <= r["g"] < len(plan)}
    light = light_classes(counts, plan)
    rows = sum(n * 1.5 * (plan[g].subsets if g < light else plan[g].keys) for g, n in counts.items())
    tasks = max(shuffle_partitions(spark), math.ceil(rows / TASK_ROWS))

    blocks = connected_components(candidate_edges(docs, width, percent, bounds, light, frequent_shingles(counted), tasks)).withColumnRenamed("node", "h1")
    members = checkpointed(classes.join(blocks.withColumnRenamed("component", "block"), "h1"))
    totals = members.groupBy("block").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("sets"))
    totals = totals.withColumn("chunks", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS)))
    units = max(4 * shuffle_partitions(spark), math.ceil((totals.where("chunks = 1").agg(F.sum("total")).first()[0] or 0) / UNIT_SHINGLES))
    dealt = members.join(totals, "block").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
    row = ["t1", "t2", "node", "copies", "block"]
    small = dealt.where("chunks = 1").select(*row, F.lit(None).cast("int").alias("side"), F.expr(f"pmod(xxhash64(block), {units}L)").alias("unit"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    other = F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other")
    large = dealt.where("chunks > 1").select("*", other).select(
        *row, F.expr("case when other = chunk then null when chunk < other then 0 else 1 end").cast("int").alias("side"), F.col("block").alias("unit"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )
    work = small.union(large)
    texts = flagged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), members.select("doc_id", "t1", "t2")).where("possible")
    # One row for each text: repeated rows are combined before the shuffle, by the key of the join.
    texts = texts.groupBy("t1", "t2").agg(F.first("doc.text").alias("text"))

    def linked(rows: pa.Table) -> pa.Table:
        return block_links(rows, width, percent)

    found = checkpointed(texts.join(work, ["t1", "t2"]).groupBy("unit", "i", "j").applyInArrow(linked, f"a {_NODE}, b {_NODE}, links long"))
    edges = found.where("b is not null").select("a", "b")
    if united and by_id:
        # Documents whose rows have different sets: their classes are one node.
        named = known.join(several, "doc_id").join(classes.select("n_shingles", "h1", "h2", "node"), ["n_shingles", "h1", "h2"])
        edges = edges.union(named.select("node", F.col("doc_id").cast(_NODE)))
    components = connected_components(edges)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = (
        classes.withColumnRenamed("node", "of").join(components, F.col("of") == F.col("node"), "left").join(links, F.col("of") == F.col("a"), "left")
        .select("n_shingles", "h1", "h2", F.col("of").alias("node"), F.coalesce("component", "of").alias("component"), F.struct("doc_id", "t1", "t2").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    id_of = lambda c: F.when(F.col(c) < F.lit(str(_BEYOND)).cast(_NODE), F.col(c)).cast("long")
    stands = F.col("component").eqNullSafe(F.col("node")) & F.struct("doc_id", "t1", "t2").eqNullSafe(F.col("first"))
    return sets.join(of_class, ["n_shingles", "h1", "h2"], "left").select(
        "doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, id_of("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, id_of("node")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "component", (stands | (F.col("n_shingles") == 0)).alias("stands"),
    )


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every document.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of `width`-word shingles. component_id is the least doc_id reachable over
    links, class_id the least with an equal set, n_links the number of other
    rows that a row links with.
    """
    return near_copies(docs, width, percent).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component of texts: that which stands for it. Rows without words stay.

    A row goes only as a near copy of another text, not for its doc_id. Only rows that a filter flags are shuffled for the exact test.
    """
    found = checkpointed(near_copies(docs, width, percent, by_id=False).where("n_shingles > 0").select("doc_id", "t1", "t2", "stands"))
    marks = found.groupBy("doc_id", "t1", "t2").agg(F.max("stands").alias("stands"), F.count("*").alias("rows")).where("not stands or rows > 1")
    marks = checkpointed(marks.select(F.col("doc_id").alias("_doc_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "stands"))
    probed = flagged(docs, marks.select(F.col("_doc_id").alias("doc_id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2")))
    same = (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & F.col("doc.doc_id").cast("long").eqNullSafe(F.col("_doc_id"))
    exact = probed.where("possible").join(marks, same, "left")
    # Of a row that stands for its component and is repeated, one stays; repeats are combined before the shuffle.
    kept = probed.where("not possible").select("doc").union(exact.where("stands is null").select("doc"))
    if not marks.where("stands").isEmpty():
        kept = kept.union(exact.where("stands").groupBy("_doc_id", "_t1", "_t2").agg(F.first("doc").alias("doc")).select("doc"))
    return kept.select("doc.*")


#: The join of three-word shingles at 90 %, by joining all shingles of all documents with one another.
ORACLE_SQL = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), words as (
  select doc_id, len(w) as n, unnest(w) as a, generate_subscripts(w, 1) as i from docs
), windows as (
  select doc_id, n, i, a, lead(a) over (partition by doc_id order by i) as b, lead(a, 2) over (partition by doc_id order by i) as c from words
), shingles as (
  select distinct doc_id, case when n < 3 then concat_ws(' ', n, a, b) else a || ' ' || b || ' ' || c end as s from windows where i = 1 or c is not null
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), links as (
  select a, b, pairs.n = p.n and pairs.n = q.n as equal_sets from pairs join sizes p on a = p.doc_id join sizes q on b = q.doc_id where 100 * pairs.n >= 90 * (p.n + q.n - pairs.n)
), reached as (
  select a as doc_id, a as other from links union select doc_id, b from reached join links on other = a
), components as (
  select doc_id, min(other) as least from reached group by doc_id
), counted as (
  select a as doc_id, count(*) as n, min(case when equal_sets then b end) as least_equal from links group by a
)
select d.doc_id, coalesce(sizes.n, 0) as n_shingles, coalesce(components.least, d.doc_id) as component_id, least(d.doc_id, coalesce(counted.least_equal, d.doc_id)) as class_id, coalesce(counted.n, 0) as n_links
from documents d left join sizes on d.doc_id = sizes.doc_id left join components on d.doc_id = components.doc_id left join counted on d.doc_id = counted.doc_id
"""
