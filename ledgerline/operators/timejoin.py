"""Joins on time: intervals with and without a key, and the latest row before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.shared import checkpointed


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


def interval_join(left: DataFrame, right: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Pairs with an equal key whose right ts is from `before` seconds before to `after` seconds after the left ts.

    Both have (key, id, ts); the result has key, left_id, right_id, left_ts, right_ts.
    Time falls into buckets as long as the interval and a left row looks into the two that
    its interval touches, so that key and bucket are an equality: the rows of a hot key
    meet those near in time alone.
    """
    width = max(1, before + after)
    a = left.select(key, F.col("id").alias("left_id"), F.col("ts").alias("left_ts")).where("left_ts is not null")
    b = right.select(key, F.col("id").alias("right_id"), F.col("ts").alias("right_ts")).where("right_ts is not null")
    reached = F.sequence(F.floor((_seconds("left_ts") - before) / width), F.floor((_seconds("left_ts") + after) / width))
    joined = a.withColumn("bucket", F.explode(reached)).join(b.withColumn("bucket", F.floor(_seconds("right_ts") / width)), [key, "bucket"])
    later = F.unix_micros(F.col("right_ts").cast("timestamp")) - F.unix_micros(F.col("left_ts").cast("timestamp"))
    return joined.where(later.between(-before * 1_000_000, after * 1_000_000)).drop("bucket")


def band_join(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """Pairs of (id, ts) rows at most `seconds` apart, without a key.

    Times fall into buckets as wide as the band, and each left row looks into its
    own and the two beside it: an equality on buckets in place of a nested loop.
    """
    bucket = lambda c: F.floor(_seconds(c) / seconds)
    a = left.select(F.col("id").alias("left_id"), F.col("ts").alias("left_ts")).where("left_ts is not null").withColumn("bucket", F.explode(F.sequence(bucket("left_ts") - 1, bucket("left_ts") + 1)))
    b = right.select(F.col("id").alias("right_id"), F.col("ts").alias("right_ts")).where("right_ts is not null").withColumn("bucket", bucket("right_ts"))
    apart = F.abs(F.unix_micros(F.col("right_ts").cast("timestamp")) - F.unix_micros(F.col("left_ts").cast("timestamp")))
    return a.join(b, "bucket").where(apart <= seconds * 1_000_000).select("left_id", "right_id", "left_ts", "right_ts")


def asof_join(left: DataFrame, right: DataFrame, key: str, seconds: int = 86_400) -> DataFrame:
    """Each left row (key, id, ts) with the latest right row of its key at or before its ts.

    Of right rows at one time that with the greatest id counts. The result has
    key, left_id, left_ts, right_id and right_ts, null where there is none.

    Rows of a key are cut into stretches of `seconds`, so that a key with a third of
    all rows is many tasks' work. A stretch finds the latest within it by one pass
    over both sides, and gets the latest from before it from one row for each stretch.
    """
    a = left.select(key, "ts", F.col("id").alias("left_id"), F.lit(None).cast(right.schema["id"].dataType).alias("right_id"), F.lit(1).alias("side"))
    b = right.where("ts is not null").select(key, "ts", F.lit(None).cast(left.schema["id"].dataType).alias("left_id"), F.col("id").alias("right_id"), F.lit(0).alias("side"))
    both = a.unionByName(b).withColumns({"stretch": F.floor(_seconds("ts") / seconds), "found": F.when(F.col("side") == 0, F.struct(F.col("ts").alias("right_ts"), "right_id"))})
    seen = Window.partitionBy(key, "stretch").orderBy("ts", "side", "right_id").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("within", F.last("found", ignorenulls=True).over(seen)).where("side = 1")
    earlier = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy(key, "stretch").agg(F.max("found").alias("last"))
    before = stretches.select(F.col(key).alias("_key"), F.col("stretch").alias("_stretch"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    joined = within.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("stretch").eqNullSafe(F.col("_stretch")), "left")
    # A left row without a time has nothing before it.
    latest = F.when(F.col("ts").isNotNull(), F.coalesce("within", "before"))
    return joined.select(key, "left_id", F.col("ts").alias("left_ts"), latest["right_id"].alias("right_id"), latest["right_ts"].alias("right_ts"))


def nearest_join(left: DataFrame, right: DataFrame, key: str, seconds: int = 86_400) -> DataFrame:
    """Each left row (key, id, ts) with the right row of its key whose ts is nearest; of several that with the least id.

    The result has left_id, right_id and apart (microseconds); left rows without a
    partner are left out. The nearest is the latest at or before, or the earliest at or after: two
    passes in order of time, within stretches as in asof_join, and never the pairs of a key.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    a = left.where("ts is not null").select(key, micros.alias("at"), F.col("id").alias("left_id"), F.lit(1).alias("side"))
    # Of rows at one time only that with the least id can be a partner.
    b = right.where("ts is not null").groupBy(key, micros.alias("at")).agg(F.min("id").alias("right_id")).withColumn("side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).withColumns({"stretch": F.floor(F.col("at") / (seconds * 1_000_000)), "found": F.when(F.col("side") == 0, F.struct("at", "right_id"))})
    stretches = both.groupBy(key, "stretch").agg(F.min("found").alias("first"), F.max("found").alias("last"))
    w = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, -1)
    beyond = stretches.select(
        F.col(key).alias("_key"), F.col("stretch").alias("_stretch"),
        F.last("last", ignorenulls=True).over(w.orderBy("stretch")).alias("outer_before"), F.last("first", ignorenulls=True).over(w.orderBy(F.desc("stretch"))).alias("outer_after"),
    )
    w = Window.partitionBy(key, "stretch").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"before": F.last("found", ignorenulls=True).over(w.orderBy("at", "side")), "after": F.last("found", ignorenulls=True).over(w.orderBy(F.desc("at"), "side"))})
    joined = seen.where("side = 1").join(beyond, F.col(key).eqNullSafe(F.col("_key")) & (F.col("stretch") == F.col("_stretch")))
    apart = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["at"] - F.col("at")).alias("apart"), c["right_id"].alias("right_id")))
    best = F.least(apart(F.coalesce("before", "outer_before")), apart(F.coalesce("after", "outer_after")))
    return joined.select("left_id", best.alias("best")).where("best is not null").select("left_id", "best.right_id", "best.apart")


def mutual_nearest(left: DataFrame, right: DataFrame, key: str, seconds: int = 86_400) -> DataFrame:
    """(left_id, right_id, apart): rows of equal key that are each other's nearest in time; ties by id."""
    of_left = nearest_join(left, right, key, seconds)
    of_right = nearest_join(right, left, key, seconds).select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    return of_left.join(of_right, ["left_id", "right_id"])


def stable_assignment(left: DataFrame, right: DataFrame, key: str, within: int | None = None, seconds: int = 86_400) -> DataFrame:
    """(left_id, right_id, apart): rows of equal key paired off so that no two that aren't partners are nearer to each other than each is to its own.

    Rounds of deferred acceptance: rows ask for the nearest that is free, and those who ask for one another
    are settled; the others ask again among what is left, until nobody has anyone to ask. The
    pair that is nearest of all (ties by left, then right id) settles in every round, so rounds come to an end, and what is
    settled never has to be undone, for either side goes by the same distance. Partners are at most
    `within` seconds apart, if that is given. Ids tell a side's rows apart.

    No round makes the pairs of a key: see nearest_join. Each leaves fewer rows, written to the checkpoint folder.
    """
    free_left, free_right, settled = left.select(key, "id", "ts"), right.select(key, "id", "ts"), None
    near = F.lit(True) if within is None else F.col("apart") <= within * 1_000_000
    while True:
        of_left = checkpointed(nearest_join(free_left, free_right, key, seconds).where(near))
        of_right = checkpointed(nearest_join(free_right, free_left, key, seconds).where(near).select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
        pairs = checkpointed(of_left.join(of_right, ["left_id", "right_id"]))
        settled = pairs if settled is None else settled.union(pairs)
        if pairs.isEmpty():
            return settled
        # Who has found nobody to ask never will: what is free only becomes less.
        free_left = checkpointed(_still_free(free_left, of_left, pairs, "left_id"))
        free_right = checkpointed(_still_free(free_right, of_right, pairs, "right_id"))


def _still_free(side: DataFrame, asking: DataFrame, settled: DataFrame, id_: str) -> DataFrame:
    waits = asking.select(id_).join(settled.select(id_), id_, "left_anti").withColumnRenamed(id_, "id")
    return side.join(waits, "id", "left_semi")


def mutual_best(pairs: DataFrame, distance: str) -> DataFrame:
    """Of candidate pairs (left_id, right_id, distance), those in which each is the other's nearest; ties by id.

    Nearest rows are aggregates that combine before the shuffle, not sorts of a
    hot row's candidates.
    """
    best_right = pairs.groupBy("left_id").agg(F.min(F.struct(distance, "right_id")).alias("b")).select("left_id", F.col("b.right_id").alias("right_id"), F.col(f"b.{distance}").alias(distance))
    best_left = pairs.groupBy("right_id").agg(F.min(F.struct(distance, "left_id")).alias("b")).select("right_id", F.col("b.left_id").alias("left_id"))
    return best_right.join(best_left, ["left_id", "right_id"])
