"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Vectors are dealt by hash into shards of about `SHARD_ROWS`, and each shard becomes a
hierarchical navigable small-world graph, a row of the index table: the vectors, the
graph as flat arrays of neighbours (one of fixed width for each level) and the ids.
Blocks of queries visit every shard, walk its graph from the top level down, and the shards'
results are merged. Results are scored anew in double precision on the original vectors,
component by component in order, so a pair's score is the same wherever it is made.

The largest inner product becomes the nearest point by one more component that gives all
of a shard's vectors the same length. Equal vectors are one node, which keeps its `KEPT` least ids: more of
them can't be among a query's results, so a vector that a third of all rows have costs one
node. A walk through a graph takes steps for many points at once, in numpy; inserting does
likewise, in batches that double, each batch's points being linked to one another as well.

Vectors that are null, empty or zero, or hold a null or a component that isn't finite, take no part.
Vectors of different lengths never meet. Of a null vec_id no query is made; it is a candidate
like any other and comes last in ties. Rows that repeat a vec_id are rows of their own, and each is
no candidate to itself only. An empty table gives an empty result. Extra columns are not read.

A search visits all shards, so its cost grows with queries times shards; the shard's size is a parameter, which a
large table should raise as far as memory goes (a shard of n vectors of d components takes about 8nd + 300n bytes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed

SHARD_ROWS, QUERY_BLOCK = 8192, 16_384
#: Results for each query, and ids kept of equal vectors: one more, for a query isn't a candidate to itself.
NEAREST = 20
KEPT = NEAREST + 1
#: Links of a node on upper levels (twice as many on the lowest), points that a walk keeps while building and while searching.
LINKS, WIDTH_BUILD, WIDTH_SEARCH = 16, 96, 256
#: Results are spread evenly over shards, for vectors are dealt by hash: each of many shards has a few of them, which narrower walks find, of this width at least.
WIDTH_LEAST = 96
#: Points whose links a walk follows in one step, and points that walk together.
AT_ONCE, TOGETHER = 6, 512
EVERY = 20

_NODE = "dim int, shard int, vector array<double>, ids array<long>"
_INDEX = "dim int, shard int, n int, vectors binary, links binary, members binary, sizes binary, ids array<long>"


class Graph:
    """A navigable small-world hierarchy over the rows of `points` (unit length): level l holds members[l], links[l] their neighbours (-1: none)."""

    def __init__(self, points: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.points, self.members, self.links = points, members, links
        self.place = []
        for m in members:
            at = np.full(len(points), -1, np.int32)
            at[m] = np.arange(len(m), dtype=np.int32)
            self.place.append(at)

    def walk(self, level: int, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, likeness), each query's `width` best that a walk over a level finds, best first; -1 where there are fewer.

        All queries step together: each follows the links of its `AT_ONCE` best nodes not
        followed so far, until all that it keeps are.
        """
        links, place, n, n_queries = self.links[level], self.place[level], len(self.points), len(queries)
        seen = np.zeros((n_queries, n), bool)
        nodes = np.full((n_queries, width), -1, np.int32)
        like = np.full((n_queries, width), -np.inf, np.float32)
        followed = np.ones((n_queries, width), bool)
        first = starts.shape[1]
        nodes[:, :first] = starts
        like[:, :first] = np.einsum("qsd,qd->qs", self.points[starts], queries)
        followed[:, :first] = False
        for i in range(1, first):  # one that is given twice is kept once
            again = (starts[:, :i] == starts[:, i : i + 1]).any(1)
            nodes[again, i], like[again, i], followed[again, i] = -1, -np.inf, True
        np.put_along_axis(seen, starts.astype(np.int64), True, 1)
        flat, active = seen.reshape(-1), np.arange(n_queries)
        while len(active):
            open_like = np.where(followed[active], -np.inf, like[active])
            k = min(AT_ONCE, width)
            best = np.argpartition(-open_like, k - 1, 1)[:, :k] if k < width else np.tile(np.arange(width), (len(active), 1))
            usable = np.take_along_axis(open_like, best, 1) > -np.inf
            going = usable.any(1)
            active, best, usable = active[going], best[going], usable[going]
            if not len(active):
                break
            followed[active[:, None], best] = True
            at = np.where(usable, nodes[active[:, None], best], -1)
            reached = np.where(at[:, :, None] >= 0, links[place[at]], -1).reshape(len(active), -1)
            row, column = np.nonzero(reached >= 0)
            key = active[row] * n + reached[row, column]
            key = np.unique(key[~flat[key]])
            flat[key] = True
            of, node = key // n, key % n
            if not len(key):
                continue
            found = np.einsum("kd,kd->k", self.points[node], queries[of])
            # Each query's new nodes, side by side with those that it keeps.
            counts = np.bincount(np.searchsorted(active, of), minlength=len(active))
            wide, row = counts.max(), np.repeat(np.arange(len(active)), counts)
            column = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
            all_nodes = np.full((len(active), width + wide), -1, np.int32)
            all_like = np.full((len(active), width + wide), -np.inf, np.float32)
            all_followed = np.ones((len(active), width + wide), bool)
            all_nodes[:, :width], all_like[:, :width], all_followed[:, :width] = nodes[active], like[active], followed[active]
            all_nodes[row, width + column], all_like[row, width + column], all_followed[row, width + column] = node, found, False
            keep = np.argpartition(-all_like, width - 1, 1)[:, :width]
            nodes[active], like[active], followed[active] = (np.take_along_axis(x, keep, 1) for x in (all_nodes, all_like, all_followed))
        order = np.argsort(-like, 1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(like, order, 1)

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Where each query enters the level `down_to`: the best nodes of the levels above."""
        starts = np.repeat(self.members[-1][None, :1], len(queries), 0)
        for level in range(len(self.members) - 1, down_to, -1):
            nodes, _ = self.walk(level, queries, starts, AT_ONCE)
            # The second and third may be missing on a small level; the best stands for them.
            starts = np.where(nodes[:, :3] >= 0, nodes[:, :3], nodes[:, :1])
        return starts

    def search(self, queries: np.ndarray, width: int = WIDTH_SEARCH) -> np.ndarray:
        return np.concatenate([self.walk(0, part, self.descend(part, 0), width)[0] for part in (queries[i : i + TOGETHER] for i in range(0, len(queries), TOGETHER))])


def _spread(points: np.ndarray, own: np.ndarray, nodes: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Of each point's candidates (best first, -1: none), `most` to link to.

    A candidate nearer to one that is taken than to the point is put off, so
    that links lead into all directions; those put off fill what is left.
    """
    n, c = nodes.shape
    of = points[nodes]
    among = np.matmul(of, of.transpose(0, 2, 1))
    taken, valid = np.zeros((n, c), bool), (nodes >= 0) & (nodes != own[:, None])
    covered, count = np.full((n, c), -np.inf, np.float32), np.zeros(n, np.int64)
    for j in range(c):
        take = valid[:, j] & (covered[:, j] < like[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        covered = np.where(take[:, None], np.maximum(covered, among[:, j]), covered)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1)[:, :most]
    chosen = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(nodes, order, 1), -1).astype(np.int32)
    return chosen if chosen.shape[1] == most else np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)


def _link_back(graph: Graph, level: int, own: np.ndarray, chosen: np.ndarray, most: int) -> None:
    """Give the nodes that `own` have been linked to a link back; those with too many links choose anew."""
    links, place = graph.links[level], graph.place[level]
    row, column = np.nonzero(chosen >= 0)
    to, back = chosen[row, column], own[row]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    column = np.arange(len(to)) - np.repeat(first, counts)
    for start in range(0, len(nodes), TOGETHER):
        some = slice(start, start + TOGETHER)
        part = np.repeat(np.arange(len(nodes[some])), counts[some])
        here = slice(first[some][0], first[some][0] + len(part))
        new = np.full((len(nodes[some]), counts[some].max()), -1, np.int32)
        new[part, column[here]] = back[here]
        wanted = np.concatenate([links[place[nodes[some]]], new], 1)
        # A node that is there already doesn't come again.
        wanted = np.sort(wanted, 1)[:, ::-1]
        wanted[:, 1:][wanted[:, 1:] == wanted[:, :-1]] = -1
        like = np.where(wanted >= 0, np.einsum("ncd,nd->nc", graph.points[wanted], graph.points[nodes[some]]), -np.inf).astype(np.float32)
        order = np.argsort(-like, 1, kind="stable")
        wanted, like = np.take_along_axis(wanted, order, 1), np.take_along_axis(like, order, 1)
        links[place[nodes[some]]] = _spread(graph.points, nodes[some], wanted, like, most)


def even_length(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one component more, by which all have length 1: a larger inner product with a query is a smaller distance."""
    scale = np.abs(vectors).max()
    scaled = vectors / scale
    squared = np.einsum("nd,nd->n", scaled, scaled)
    most = squared.max()
    return np.concatenate([scaled, np.sqrt(np.maximum(0, most - squared))[:, None]], 1).astype(np.float32) / np.float32(math.sqrt(most))


def build_graph(vectors: np.ndarray, links: int = LINKS, width: int = WIDTH_BUILD, seed: int = 1) -> Graph:
    """The hierarchy over distinct vectors; the same for the same vectors in the same order."""
    points, n = even_length(vectors), len(vectors)
    random = np.random.default_rng(seed)
    height = np.minimum(np.floor(-np.log(1 - random.random(n)) / math.log(links)).astype(int), max(0, math.ceil(math.log(max(2, n), links)) - 1))
    # Taller nodes first, so that all levels above are complete before the lowest begins.
    order = np.argsort(-height, kind="stable")
    tall = [order[height[order] >= level] for level in range(height.max() + 1)]
    graph = Graph(points, [m.astype(np.int32) for m in tall], [np.full((len(m), links * (1 + (level == 0))), -1, np.int32) for level, m in enumerate(tall)])
    for level in range(len(tall) - 1, -1, -1):
        done, most = 1, graph.links[level].shape[1]
        while done < len(tall[level]):
            own = tall[level][done : done + min(max(8, done // 2), TOGETHER)]
            starts = graph.descend(points[own], level) if level + 1 < len(tall) else np.repeat(tall[level][None, :1], len(own), 0)
            # Levels below the top enter by nodes that stand on this level and have been linked here.
            nodes, like = graph.walk(level, points[own], starts, min(width, max(AT_ONCE, done)))
            beside = points[own] @ points[own].T
            np.fill_diagonal(beside, -np.inf)
            near = np.argsort(-beside, 1, kind="stable")[:, : min(len(own), most)]
            nodes = np.concatenate([nodes, own[near].astype(np.int32)], 1)
            like = np.concatenate([np.where(nodes[:, : like.shape[1]] >= 0, like, -np.inf), np.take_along_axis(beside, near, 1)], 1)
            best = np.argsort(-like, 1, kind="stable")[:, : max(width, most)]
            nodes, like = np.take_along_axis(nodes, best, 1), np.take_along_axis(like, best, 1)
            chosen = _spread(points, own, np.where(like > -np.inf, nodes, -1), like, links)
            graph.links[level][graph.place[level][own], :links] = chosen
            _link_back(graph, level, own.astype(np.int32), chosen, most)
            done += len(own)
    return graph


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up in order of the components."""
    total = a[..., 0] * b[..., 0]
    for d in range(1, a.shape[-1]):
        total = total + a[..., d] * b[..., d]
    return total


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("vector")).where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _nodes(usable: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """(dim, shard, vector, ids): distinct vectors with their least ids, and how many shards a length has."""
    hashed = usable.select("vec_id", "vector", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit("second"), "vector").alias("b"))
    # Limits of a window are applied before its shuffle too: of a common vector each task sends `KEPT` rows.
    least = Window.partitionBy("a", "b").orderBy(F.col("vec_id").asc_nulls_last())
    few = hashed.withColumn("n", F.row_number().over(least)).where(F.col("n") <= KEPT)
    once = checkpointed(few.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.transform(F.array_sort(F.collect_list(F.struct("n", "vec_id"))), lambda x: x["vec_id"]).alias("ids")))
    shards = max(1, math.ceil(once.count() / shard_rows))
    return once.select(F.size("vector").alias("dim"), F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids"), shards


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index over (vec_id, embedding), a row for each shard, kept in the checkpoint folder; and how many shards there are."""

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = np.stack([np.asarray(v, np.float64) for v in group["vector"].to_numpy()])
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        graph = build_graph(rows)
        ids = group["ids"].combine_chunks().take(pa.array(order))
        sizes = np.array([[m.shape[0], x.shape[1]] for m, x in zip(graph.members, graph.links, strict=True)], np.int32)
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        flat = lambda arrays: b"".join(x.tobytes() for x in arrays)
        row = [key[0].as_py(), key[1].as_py(), len(rows), rows.tobytes(), flat(graph.links), flat(graph.members), flat([np.int32([len(sizes)]), sizes, counts]), ids.flatten().to_pylist()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    nodes, shards = _nodes(_usable(vectors), shard_rows)
    return checkpointed(nodes.repartitionById(shards, "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX)), shards


def load_graph(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, vectors, where each node's ids begin and end, ids) of a row of the index."""
    n = row["n"]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
    numbers = np.frombuffer(row["sizes"], np.int32)
    sizes, counts = numbers[1 : 1 + 2 * numbers[0]].reshape(-1, 2), numbers[1 + 2 * numbers[0] :]
    cut = lambda data, lengths: np.split(np.frombuffer(data, np.int32), np.cumsum(lengths)[:-1])
    members = cut(row["members"], sizes[:, 0])
    links = [x.reshape(m, w) for x, (m, w) in zip(cut(row["links"], sizes[:, 0] * sizes[:, 1]), sizes, strict=True)]
    ids = np.array(row["ids"], object)
    return Graph(even_length(vectors), members, links), vectors, np.concatenate([[0], np.cumsum(counts)]), ids


def _best_of_shard(row: dict, queries: pa.Table, nearest: int, width: int) -> pa.Table:
    graph, vectors, begins, ids = load_graph(row)
    asked = np.stack([np.asarray(v, np.float64) for v in queries["vector"].to_numpy()])
    unit = np.concatenate([asked / np.abs(asked).max(1, keepdims=True), np.zeros((len(asked), 1))], 1).astype(np.float32)
    out: list[list] = [[], [], [], []]
    told = [queries[c].to_pylist() for c in ("_q", "query_id")]
    # A part of the queries at a time: their vectors beside those of all that is found.
    for start in range(0, len(asked), TOGETHER):
        part = slice(start, start + TOGETHER)
        found = graph.search(unit[part], min(width, len(vectors)))
        exact = np.where(found >= 0, scores(vectors[found], asked[part][:, None, :]), -np.inf)
        order = np.argsort(-exact, 1, kind="stable")
        for q, query_id, nodes, like, vector in zip(told[0][part], told[1][part], np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1), asked[part], strict=True):
            rows, worst = [], None
            for node, score in zip(nodes.tolist(), like.tolist(), strict=True):
                if node < 0 or (worst is not None and score < worst):
                    break
                own = list(ids[begins[node] : begins[node + 1]])
                if query_id in own and np.array_equal(vectors[node], vector):
                    own.remove(query_id)
                rows += [(score, i) for i in own]
                if worst is None and len(rows) >= nearest:
                    worst = score  # those that tie with it are compared by id
            rows.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            for score, i in rows[:nearest]:
                for column, value in zip(out, (q, query_id, i, score), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["_q", "query_id", "vec_id", "score"])


def search_index(index: DataFrame, shards: int, queries: DataFrame, nearest: int = NEAREST, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `nearest` of each row of `queries` (vec_id, embedding); that row itself is no candidate. At most `NEAREST`."""
    if nearest > NEAREST:
        raise ValueError(f"the index keeps ids for {NEAREST} results")
    width = width or max(WIDTH_LEAST, math.ceil(WIDTH_SEARCH / math.sqrt(shards)))

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return _best_of_shard(left.to_pylist()[0], right, nearest, width)

    empty = pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["_q", "query_id", "vec_id", "score"])
    asked = checkpointed(_usable(queries).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("_q")))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block, all_shards = F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(shards - 1))
    # Each query goes to each shard, and each shard to each block of queries.
    sent = asked.select("_q", "query_id", "vector", "dim", block.alias("block"), F.explode(all_shards).alias("shard"))
    graphs = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = graphs.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(search, "_q long, query_id long, vec_id long, score double")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest_vectors(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The `nearest` of each row of (vec_id, embedding) whose vec_id `every` divides, among all rows but itself."""
    index, shards = build_index(vectors, shard_rows)
    return search_index(index, shards, vectors.where(F.col("vec_id") % every == 0), nearest)
