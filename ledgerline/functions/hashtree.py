"""Trees of digests over tables: where two versions of a table differ is found from the root down.

A row's leaf is named by the first hex digits of its key's hash, and a node by the digits that its leaves share,
so a table of any size has a tree of fixed size. A leaf's digest sums its rows' hashes, so partial sums
combine and a leaf with a third of all rows is many tasks' work; an inner node's digest is that of
its children's names and digests. Leaves without rows have no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import canonical
from ledgerline.sources.shared import checkpointed

#: Levels below the root, of 16 children each, and hex digits that name a branch: rows are stored by branches.
DEPTH, BRANCH = 3, 1
#: Differing leaves up to which their names are broadcast; there are 16 to the power of DEPTH.
BROADCAST_LEAVES = 1 << 16


def leaf_path(df: DataFrame, key: list[str], depth: int = DEPTH) -> Column:
    return F.left(canonical.row_hash(df.select(*key), key), F.lit(depth))


def hash_tree(df: DataFrame, key: list[str], depth: int = DEPTH) -> DataFrame:
    """(level, path, n_rows, digest) of every node, the root's path being empty. The rows are read once."""
    leaves = canonical.grouped_digests(df.select(leaf_path(df, key, depth).alias("_path"), F.struct("*").alias("_row")), "_path", "_row").withColumnRenamed("_path", "path")
    levels = [checkpointed(leaves)]
    for length in range(depth - 1, -1, -1):
        child = F.struct(F.substring("path", length + 1, 1).alias("digit"), "digest")
        # 16 children at most.
        children = F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(c["digit"], c["digest"]))
        levels.append(levels[-1].groupBy(F.left("path", F.lit(length)).alias("path")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(children, ""), 256).alias("digest")))
    return reduce(DataFrame.unionByName, levels).select(F.length("path").cast("int").alias("level"), "path", "n_rows", "digest")


def differing(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, path, before, after): nodes of two trees whose digests differ, found from the root down; null where one has none.

    Below a node that agrees nothing is looked at.
    """
    before, after = checkpointed(before), checkpointed(after)
    found, parents = [], None
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("path", F.col("digest").alias(name)) for t, name in ((before, "before"), (after, "after"))]
        if parents is not None:
            sides = [s.join(F.broadcast(parents), F.left("path", F.lit(level - 1)) == F.col("parent"), "left_semi") for s in sides]
        here = checkpointed(sides[0].join(sides[1], "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))))
        found.append(here.select(F.lit(level).alias("level"), "path", "before", "after"))
        # 16 to the power of the level, at most.
        parents = here.select(F.col("path").alias("parent"))
    return reduce(DataFrame.unionByName, found)


def changed_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows_before, rows_after, change): keys whose rows differ, repeats counted; change is added, removed or changed.

    One aggregate over both sides, in which repeats of a key combine before the shuffle.
    """
    columns = before.columns
    both = before.select(*columns, F.lit(1).alias("_old")).unionByName(after.select(*columns, F.lit(0).alias("_old")))
    lanes = canonical.lanes(canonical.row_hash(both, sorted(columns)))
    sides = {"before": F.col("_old") == 1, "after": F.col("_old") == 0}
    sums = [F.sum(F.when(here, lane)).cast("decimal(38,0)").alias(f"_{side}{i}") for side, here in sides.items() for i, lane in enumerate(lanes)]
    counts = [F.count(F.when(here, 1)).alias(f"rows_{side}") for side, here in sides.items()]
    grouped = both.groupBy(*key).agg(*counts, *sums)
    same = reduce(lambda a, b: a & b, [F.col(f"_before{i}").eqNullSafe(F.col(f"_after{i}")) for i in range(len(lanes))])
    change = F.when(F.col("rows_before") == 0, "added").when(F.col("rows_after") == 0, "removed").otherwise("changed")
    return grouped.where(~same).select(*key, "rows_before", "rows_after", change.alias("change"))
