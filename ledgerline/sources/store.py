"""The store of evaluations: append-only parquet whose manifests form a chain.

An evaluation is its results, its inputs if they are to be kept, the hash trees of those, and a
manifest that is written last and completes it. Each attempt to write one has files of its own, so
nothing is ever written over: what failed before its manifest isn't seen.

Each manifest has its place in the chain and the digest of the manifest before it, so that one
that was altered or taken away is found at its place; its digest of the results tells whether those were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import canonical
from ledgerline.functions.hashtree import BRANCH, hash_tree, leaf_path

#: The column that says under which name an evaluation is stored, and which attempt to write it succeeded.
NAME, ATTEMPT = "evaluation", "attempt"
#: Names are written with this before them: no reader takes one for a number, a date or null.
_PREFIX = "="
#: The manifest before the first.
GENESIS = "0" * 64
PLACE, PREVIOUS, DIGEST = "place", "previous_digest", "manifest_digest"


def _escaped(value: str) -> str:
    """A partition's value as the name of a folder, which Spark reads back."""
    return "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):02X}" if c.isascii() else c for c in value)


def _manifest_hash(manifest: DataFrame) -> Column:
    """The hash of a manifest's columns that aren't null, with their names."""
    kinds = {f.name: f.dataType for f in manifest.schema if f.name not in (DIGEST, ATTEMPT)}
    told = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c), canonical.encoded(c, kinds[c]))) for c in sorted(kinds)]
    return F.sha2(F.concat_ws("|", *told), 256)


class EvaluationStore:
    """Evaluations under one path, whose results have the same columns. Appends from several places at once are no conflict of files, but `verified` tells of manifests that share a place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, name: str, results: DataFrame, manifest_of: Callable[[DataFrame], DataFrame], inputs: dict[str, DataFrame] | None = None, key: list[str] | None = None) -> None:
        """Add an evaluation under a new name; those there stay as they are.

        `manifest_of` makes the manifest, one row, from the results as they are read back: the result is evaluated once, and
        what is digested is what is stored. `inputs` by name are kept whole, by branches of
        the hash trees over their `key`.
        """
        if self.has(name):
            raise ValueError(f"there is an evaluation {name!r} already")
        if (kinds := self._kinds()) not in (None, results.dtypes):
            raise ValueError(f"results of this store have the columns {kinds}")
        attempt = uuid.uuid4().hex
        self._write("results", name, attempt, results)
        for part, rows in (inputs or {}).items():
            placed = rows.withColumn("path", leaf_path(rows, key))
            self._write(f"inputs/{part}", name, attempt, placed.withColumn("branch", F.concat(F.lit(_PREFIX), F.left("path", F.lit(BRANCH)))).sortWithinPartitions("path"), "branch")
            stored = self._read(f"inputs/{part}", name, attempt).drop("branch", "path")
            self._write(f"trees/{part}", name, attempt, hash_tree(stored, key))
        manifest = manifest_of(self._read("results", name, attempt))
        last = self._last()
        chained = manifest.withColumns({NAME: F.lit(name), PLACE: F.lit(last[0] + 1).cast("long"), PREVIOUS: F.lit(last[1])})
        chained = chained.withColumn(DIGEST, _manifest_hash(chained))
        self._write("manifests", name, attempt, chained.drop(NAME))

    def append_batch(self, stream: str, batch: DataFrame, batch_id: int) -> bool:
        """Add a stream's micro-batch, once: one that is there already, since its stream began again before it could note the batch, is left alone."""
        name = f"{stream}/{batch_id}"
        if self.has(name):
            return False
        self.append(name, batch, lambda stored: canonical.table_digest(stored).select(F.col("n_rows").alias("output_rows"), F.col("digest").alias("output_digest")))
        return True

    def has(self, name: str) -> bool:
        return self._attempt(name) is not None

    def results(self, name: str | None = None) -> DataFrame:
        """Results of completed evaluations; of one, only its own files are opened."""
        if name is not None:
            return self._read("results", name, self._known(name)).withColumn(NAME, F.lit(name))
        return self._completed(self._read("results"))

    def inputs(self, name: str, part: str, branches: list[str] | None = None) -> DataFrame:
        """An evaluation's input as it was, with the tree's `path` of each row; of the given branches only, their files alone are opened."""
        rows = self._read(f"inputs/{part}", name, self._known(name))
        return (rows if branches is None else rows.where(F.col("branch").isin([_PREFIX + b for b in branches]))).drop("branch")

    def tree(self, name: str, part: str) -> DataFrame:
        return self._read(f"trees/{part}", name, self._known(name))

    def manifests(self, name: str | None = None) -> DataFrame:
        if name is None:
            return self._read("manifests").drop(ATTEMPT)
        return self._read("manifests", name, self._known(name)).withColumn(NAME, F.lit(name))

    def verified(self, head: str | None = None) -> DataFrame:
        """What is wrong with each place of the chain: (place, evaluation, problem), null where nothing is.

        `head` is the digest of the newest manifest, as its reader has noted it; without, a loss of the
        newest can't be told.
        """
        manifests = self._read("manifests")
        known = manifests.drop(ATTEMPT)
        each = known.select(PLACE, NAME, PREVIOUS, DIGEST, "output_digest", (_manifest_hash(known) == F.col(DIGEST)).alias("intact"))
        before = known.groupBy((F.col(PLACE) + 1).alias(PLACE)).agg(F.min(DIGEST).alias("before"))
        sharing = known.groupBy(PLACE).agg(F.count("*").alias("sharing"))
        stored = self._completed(self._read("results")).withColumnRenamed(NAME, "part")
        digests = canonical.grouped_digests(stored, "part").select(F.col("part").alias(NAME), F.col("digest").alias("found"))
        joined = each.join(before, PLACE, "left").join(sharing, PLACE).join(digests, NAME, "left")
        linked = F.col(PREVIOUS) == F.coalesce("before", F.lit(GENESIS))
        same = F.coalesce("found", F.lit(canonical.digest_of_nothing())) == F.col("output_digest")
        first = F.when(~F.col("intact"), "altered manifest").when(F.col("sharing") > 1, "shared place").when(~linked, "broken before").when(~same, "altered results")
        found = joined.select(PLACE, NAME, first.alias("problem"))
        if head is None:
            return found
        there = known.agg(F.max_by(DIGEST, PLACE).alias("head"), F.coalesce(F.max(PLACE), F.lit(0)).alias("last"))
        lost = there.where(F.coalesce(F.col("head") != head, F.lit(True))).select((F.col("last") + 1).alias(PLACE), F.lit(None).cast("string").alias(NAME), F.lit("newest missing").alias("problem"))
        return found.unionByName(lost)

    def _write(self, part: str, name: str, attempt: str, rows: DataFrame, *by: str) -> None:
        folder = f"{self.path}/{part}/{NAME}={_escaped(_PREFIX + name)}/{ATTEMPT}={_escaped(_PREFIX + attempt)}"
        if by:
            # A file without rows, so that an input which has none has its columns.
            rows.limit(0).drop(*by).write.parquet(f"{folder}/{by[0]}={_escaped(_PREFIX)}")
        rows.write.mode("append").partitionBy(*by).parquet(folder)

    def _read(self, part: str, name: str | None = None, attempt: str | None = None) -> DataFrame:
        # Manifests are few, and may tell of different things.
        rows = self.spark.read.option("mergeSchema", part == "manifests").parquet(f"{self.path}/{part}")
        if name is not None:
            # Predicates on partition columns: other evaluations' files aren't opened.
            return rows.where((F.col(NAME) == _PREFIX + name) & (F.col(ATTEMPT) == _PREFIX + attempt)).drop(NAME, ATTEMPT)
        return rows.withColumn(NAME, F.substring(NAME, len(_PREFIX) + 1, 1 << 30))

    def _completed(self, rows: DataFrame) -> DataFrame:
        """Rows of attempts that have a manifest: a row for each evaluation, which Spark broadcasts as long as they are few."""
        return rows.join(self._read("manifests").select(NAME, ATTEMPT), [NAME, ATTEMPT], "left_semi").drop(ATTEMPT)

    def _known(self, name: str) -> str:
        attempt = self._attempt(name)
        if attempt is None:
            raise KeyError(f"there is no evaluation {name!r}")
        return attempt

    def _kinds(self) -> list[tuple[str, str]] | None:
        return None if self._first(lambda m: m, tuple, None) is None else self._read("results").drop(NAME, ATTEMPT).dtypes

    def _attempt(self, name: str) -> str | None:
        return self._first(lambda m: m.where(F.col(NAME) == name).select(ATTEMPT), lambda r: r[0].removeprefix(_PREFIX), None)

    def _last(self) -> tuple[int, str]:
        return self._first(lambda m: m.agg(F.max(F.struct(PLACE, DIGEST)).alias("last")).where("last is not null").select("last.*"), tuple, (0, GENESIS))

    def _first(self, of: Callable[[DataFrame], DataFrame], told: Callable, otherwise):
        """The one row that `of` makes of the manifests; `otherwise` if there is none, or nothing has been stored."""
        try:
            row = of(self._read("manifests")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return otherwise
        return otherwise if row is None else told(row)
