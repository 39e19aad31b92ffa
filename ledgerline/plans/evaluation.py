"""Evaluations that can be reproduced: manifests of what went in and came out, and replays against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import hashtree
from ledgerline.functions.canonical import table_digests
from ledgerline.operators.reconcile import Profile, reconcile
from ledgerline.sources.shared import checkpointed
from ledgerline.sources.store import EvaluationStore

VERSION = "2"
RESULT = ["record_id", "left_amount", "right_amount", "left_ts", "right_ts", "delta", "class", "flags"]
PARTS = ["left", "right", "output"]


def evaluate(left: DataFrame, right: DataFrame, profile: Profile = Profile()) -> DataFrame:
    return reconcile(left, right, profile).select(*RESULT)


def input_digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """The digests of both inputs, kept, for the manifests of several evaluations of the same inputs."""
    return checkpointed(table_digests({"left": left, "right": right}))


def manifest(left: DataFrame, right: DataFrame, results: DataFrame, profile: Profile = Profile(), inputs: DataFrame | None = None) -> DataFrame:
    """One row: the digests of both inputs and the output, the profile, and the version that made it.

    Lazy: whoever reads it more than once should keep it, as the store does. With `inputs`, their
    digests as `input_digests` has them, only the output is read.
    """
    tables = dict(zip(PARTS, (left, right, results), strict=True))
    digests = table_digests(tables) if inputs is None else table_digests({"output": results}).unionByName(inputs)
    of = lambda part, column: F.max(F.when(F.col("part") == part, F.col(column))).alias(f"{part}_{column.removeprefix('n_')}")
    # Three rows, one for each part.
    row = digests.groupBy().agg(*[of(p, c) for p in PARTS for c in ("n_rows", "digest")])
    described = f"{'+'.join(profile.key)};{profile.amount_tolerance};{profile.days_tolerance}"
    whole = F.sha2(F.concat_ws("|", F.lit(VERSION), F.lit(described), *[f"{p}_digest" for p in PARTS]), 256)
    return row.select(whole.alias("evaluation_id"), F.lit(described).alias("profile"), F.lit(VERSION).alias("engine_version"), *row.columns)


def replay(left: DataFrame, right: DataFrame, stored: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Evaluate anew and hold each digest against the stored manifest: part, stored, replayed, reproduced."""
    now = manifest(left, right, evaluate(left, right, profile), profile)
    parts = [*[f"{p}_digest" for p in PARTS], "evaluation_id"]
    unpivot = lambda df, name: df.unpivot([], parts, "part", name)
    return unpivot(stored.select(*parts), "stored").join(unpivot(now.select(*parts), "replayed"), "part").withColumn("reproduced", F.col("stored") == F.col("replayed"))


def store_evaluation(store: EvaluationStore, name: str, left: DataFrame, right: DataFrame, profile: Profile = Profile(), keep_inputs: bool = True) -> None:
    """Evaluate once and store the results, the manifest of what is stored, and unless told otherwise the inputs and their hash trees.

    With inputs kept, all that is digested is what was stored: an evaluation can then be
    reproduced whatever becomes of its sources.
    """
    inputs = {"left": left, "right": right} if keep_inputs else None
    store.append(name, evaluate(left, right, profile), lambda stored: manifest(left, right, stored, profile), inputs, list(profile.key))


def stored_inputs(store: EvaluationStore, name: str) -> tuple[DataFrame, DataFrame]:
    return tuple(store.inputs(name, part).drop("path") for part in ("left", "right"))


def replay_offline(store: EvaluationStore, name: str, profile: Profile = Profile()) -> DataFrame:
    """As replay, from the inputs that the store has kept."""
    return replay(*stored_inputs(store, name), store.manifests(name), profile)


def changed_since(store: EvaluationStore, name: str, part: str, now: DataFrame, key: tuple[str, ...] = Profile().key) -> DataFrame:
    """(path, key, rows_before, rows_after, change): rows of an input that aren't what an evaluation had.

    The hash tree of what there is now is held against the stored one from the root down;
    of the stored rows, only the branches in which they differ are read.
    """
    spark = store.spark
    columns = [c for c in store.inputs(name, part).columns if c != "path"]
    now = now.select(*columns)
    leaves = checkpointed(hashtree.differing(store.tree(name, part), hashtree.hash_tree(now, list(key))).where(F.col("level") == hashtree.DEPTH).select("path"))
    # 16 names at most.
    branches = sorted(r[0] for r in leaves.select(F.left("path", F.lit(hashtree.BRANCH))).distinct().collect())
    if not branches:
        stored = spark.createDataFrame([], store.inputs(name, part).schema)
    else:
        stored = store.inputs(name, part, branches)
    within = F.broadcast(leaves) if leaves.count() <= hashtree.BROADCAST_LEAVES else leaves
    sides = [rows.join(within, "path", "left_semi") for rows in (stored, now.withColumn("path", hashtree.leaf_path(now, list(key))))]
    return hashtree.changed_rows(*sides, key=["path", *key])
