"""Keyed reconciliation of records with evidence, and classes of discrepancy."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In order of precedence: the first that holds is a row's class.
CLASSES = ["missing_right", "missing_left", "inconclusive", "duplicate_left", "duplicate_right", "amount_mismatch", "within_tolerance", "date_mismatch", "matched"]


@dataclass(frozen=True)
class Profile:
    """How two sides are compared: their key, and what may differ by how much."""

    key: tuple[str, ...] = ("record_id",)
    amount: str = "amount"
    when: str = "event_ts"
    amount_tolerance: str = "0.01"
    days_tolerance: int = 0


def flags(profile: Profile, tolerance: Column | None = None) -> dict[str, Column]:
    """Every fault that a joined row can have, whatever its class."""
    off = F.abs(F.col("right_amount") - F.col("left_amount"))
    tolerance = F.lit(profile.amount_tolerance).cast("decimal(18,2)") if tolerance is None else tolerance
    days = F.abs(F.datediff("right_ts", "left_ts"))
    both = F.col("left_rows").isNotNull() & F.col("right_rows").isNotNull()
    same_day = F.col("left_ts") == F.col("right_ts") if profile.days_tolerance == 0 else days <= profile.days_tolerance
    unclear = both & (F.col("left_amount").isNull() | F.col("right_amount").isNull() | F.col("left_ts").isNull() | F.col("right_ts").isNull())
    return {
        "missing_right": F.col("right_rows").isNull(),
        "missing_left": F.col("left_rows").isNull(),
        "inconclusive": unclear,
        "duplicate_left": both & (F.col("left_rows") > 1),
        "duplicate_right": both & (F.col("right_rows") > 1),
        "amount_mismatch": both & (off > tolerance),
        "within_tolerance": both & (off > 0) & (off <= tolerance),
        "date_mismatch": both & ~same_day,
    }


def classified(joined: DataFrame, profile: Profile, tolerance: Column | None = None) -> DataFrame:
    """`joined` with delta, class and flags."""
    found = flags(profile, tolerance)
    cls = F.lit("matched")
    for name in reversed(CLASSES[:-1]):
        cls = F.when(found[name], name).otherwise(cls)
    listed = F.array_compact(F.array(*[F.when(found[name], name) for name in CLASSES[:-1]]))
    delta = F.coalesce("right_amount", F.lit(0)).cast("decimal(18,2)") - F.coalesce("left_amount", F.lit(0)).cast("decimal(18,2)")
    return joined.withColumns({"delta": delta.cast("decimal(18,2)"), "class": cls, "flags": listed})


def joined_sides(left: DataFrame, right: DataFrame, profile: Profile, also: tuple[str, ...] = ()) -> DataFrame:
    """Both sides by key (null keys equal null keys), one row for each key that either has.

    Of a key's rows on a side: how many there are, and the amount and time of one
    of them, the first by amount and time (nulls last); of columns `also`, the least
    over both sides. This is one aggregate over both sides in place of a full outer
    join: a single shuffle, before which repeats of a key are combined.
    """
    columns = [*profile.key, profile.amount, profile.when, *also]
    both = left.select(*columns, F.lit(True).alias("is_left")).unionByName(right.select(*columns, F.lit(False).alias("is_left")))
    first, kept = F.struct(F.col(profile.amount).isNull(), F.col(profile.amount).alias("amount"), F.col(profile.when).isNull(), F.col(profile.when).alias("ts")), []
    found = []
    for side, here in (("left", F.col("is_left")), ("right", ~F.col("is_left"))):
        found += [F.min(F.when(here, first)).alias(f"_{side}"), F.nullif(F.count(F.when(here, 1)), F.lit(0)).alias(f"{side}_rows")]
        kept += [F.col(f"_{side}.amount").alias(f"{side}_amount"), F.col(f"_{side}.ts").alias(f"{side}_ts"), f"{side}_rows"]
    return both.groupBy(*profile.key).agg(*found, *[F.min(c).alias(c) for c in also]).select(*profile.key, *kept, *also)


def reconcile(left: DataFrame, right: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """One row for each key: both amounts and dates, delta (right - left), class and flags. Lazy."""
    return classified(joined_sides(left, right, profile), profile)


def reconcile_by_kind(left: DataFrame, right: DataFrame, tolerances: DataFrame, profile: Profile = Profile(), broadcast_rows: int = 10_000) -> DataFrame:
    """As reconcile, with the amount tolerance of each record's kind from `tolerances` (kind, tolerance).

    A kind that is listed more than once has its least tolerance. That table is
    broadcast if it has no more than `broadcast_rows` rows, and joined as Spark sees
    fit if it has.
    """
    tolerances = tolerances.groupBy("kind").agg(F.min("tolerance").alias("tolerance"))
    if tolerances.limit(broadcast_rows + 1).count() <= broadcast_rows:
        tolerances = F.broadcast(tolerances)
    joined = joined_sides(left, right, profile, ("kind",)).join(tolerances, "kind", "left")
    return classified(joined, profile, F.coalesce("tolerance", F.lit(profile.amount_tolerance).cast("decimal(18,2)")))


def unmatched(side: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of `side` whose key the other side doesn't have."""
    return side.join(other.select(key), key, "left_anti")


def with_evidence(side: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of `side` whose key the other side has, each once however often it has it."""
    return side.join(other.select(key), key, "left_semi")


def tolerance_matches(left: DataFrame, right: DataFrame, key: str, tolerance: str) -> DataFrame:
    """Pairs with an equal key and amounts that are at most `tolerance` apart.

    Amounts fall into buckets twice as wide as the tolerance, and a left row looks into the one or two that it
    reaches, so that key and bucket are an equality: of a repeated key, rows meet
    those of nearby amounts alone.
    """
    width = F.greatest(2 * F.lit(tolerance).cast("decimal(18,2)"), F.lit("0.01").cast("decimal(18,2)"))
    bucket = lambda amount: F.floor(amount / width)
    within = F.lit(tolerance).cast("decimal(18,2)")
    r = right.select(F.col(key), F.col("amount").alias("right_amount"), bucket(F.col("amount")).alias("_bucket")).where("_bucket is not null")
    reached = F.array_distinct(F.array(bucket(F.col("amount") - within), bucket(F.col("amount") + within)))
    pairs = left.where("amount is not null").withColumn("_bucket", F.explode(reached)).join(r, [key, "_bucket"])
    return pairs.where(F.abs(F.col("right_amount") - F.col("amount")) <= within).select(key, "amount", "right_amount")


def _sets(n: int, largest: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All sets of up to `largest` of n places, the smallest first and then those whose places come first; and as columns of a matrix of 0 and 1."""
    sets = [s for size in range(1, min(n, largest) + 1) for s in combinations(range(n), size)]
    chosen = np.zeros((n, len(sets)), np.int64)
    for i, s in enumerate(sets):
        chosen[list(s), i] = 1
    return sets, chosen


#: Sums that a task holds at once.
_SUMS = 1 << 20


def _settling(largest: int, within: int):
    """Of arrays of cents and amounts in cents: the places of the first set that adds up to the amount, give or take `within`; null if none does, or of nulls.

    Rows with so many entries are tried together, by one product with all sets of so many places.
    """

    known: dict = {}

    @F.arrow_udf("array<int>")
    def settling(parts: pa.Array, amounts: pa.Array) -> pa.Array:
        found: list = [None] * len(amounts)
        sizes = pc.if_else(pc.is_valid(amounts), pc.fill_null(pc.list_value_length(parts), 0), 0).to_numpy(zero_copy_only=False)
        for n in map(int, np.unique(sizes[sizes > 0])):
            if n not in known:
                known[n] = _sets(n, largest)
            sets, chosen = known[n]
            of_size = np.flatnonzero(sizes == n)
            for rows in np.array_split(of_size, len(of_size) * len(sets) // _SUMS + 1):
                if len(rows):
                    of_rows = parts.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    # Sums past 64 bits come round, and no difference of so few amounts of 18 digits comes back to near 0.
                    fits = np.abs(of_rows @ chosen - amounts.take(pa.array(rows)).to_numpy(zero_copy_only=False)[:, None]) <= within
                    first = fits.argmax(1)
                    for i in np.flatnonzero(fits.any(1)):
                        found[rows[i]] = sets[first[i]]
        return pa.array(found, pa.list_(pa.int32()))

    return settling


#: Entries of a key and period up to which sets of them are tried.
MOST_ENTRIES = 12


def split_settlements(records: DataFrame, entries: DataFrame, key: str, days: int, tolerance: str = "0.00", most: int = MOST_ENTRIES, largest: int | None = None) -> DataFrame:
    """Records (key, id, amount, ts) with the entries (key, id, amount, ts) that pay each together.

    Of each record: how many entries its key has in the same period of so many days (n_entries), its class, and
    the ids that pay it (paid_by). It is `settled` if the amounts of some, of `largest` at most, add up to its own, give or take the tolerance:
    of all such sets the smallest, and of those that whose sorted ids come first. It is `unsettled` if none do, and
    `inconclusive` if there are more than `most` entries, whose sets aren't tried, and no single one pays it.

    Key and period, and for single entries the amount's bucket, are equalities. Of a period's entries `most` and one more are
    kept, in one row, so no join gives the pairs of a key. An entry may pay several records: whose it is, is for an assignment to say.
    Records without amount or time are inconclusive; entries without are left out. Null keys equal no key.
    """
    within = F.lit(tolerance).cast("decimal(18,2)")
    period = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (days * 86_400_000_000))
    due = records.select(key, "id", "amount", period.alias("_period"))
    paid = entries.where("amount is not null and ts is not null").select(key, F.col("id").alias("entry"), F.col("amount").alias("part"), period.alias("_period"))
    counted = paid.groupBy(key, "_period").agg(F.count("*").alias("n_entries"))
    # Limits of a window are applied before its shuffle, too.
    few = paid.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_period").orderBy("entry"))).where(F.col("_n") <= most + 1)
    listed = few.groupBy(key, "_period").agg(F.array_sort(F.collect_list(F.struct("entry", "part"))).alias("listed"))
    width = F.greatest(2 * within, F.lit("0.01").cast("decimal(18,2)"))
    reached = F.array_distinct(F.array(F.floor((F.col("amount") - within) / width), F.floor((F.col("amount") + within) / width)))
    # Of entries with one amount the first stands for all.
    alike = paid.groupBy(key, "_period", "part").agg(F.min("entry").alias("entry")).withColumn("_at", F.floor(F.col("part") / width))
    asked = due.where("amount is not null").withColumn("_at", F.explode(reached))
    singles = asked.join(alike, [key, "_period", "_at"]).where(F.abs(F.col("part") - F.col("amount")) <= within).groupBy("id").agg(F.array(F.min("entry")).alias("single"))
    joined = due.join(counted, [key, "_period"], "left").join(listed, [key, "_period"], "left").join(singles, "id", "left")
    n = F.coalesce("n_entries", F.lit(0))
    tried = F.col("single").isNull() & (F.size("listed") <= most)
    cents = lambda amount: (amount.cast("decimal(18,2)") * 100).cast("long")
    places = _settling(largest or most, int(Decimal(tolerance).scaleb(2)))(F.when(tried, F.transform("listed", lambda e: cents(e["part"]))), F.when(tried, cents(F.col("amount"))))
    by = F.coalesce("single", F.transform(places, lambda i: F.element_at("listed", i + 1)["entry"]))
    told = joined.select(key, "id", "amount", n.alias("n_entries"), F.col("amount").isNull() | F.col("_period").isNull() | (n > most), by.alias("paid_by")).toDF(key, "id", "amount", "n_entries", "_unclear", "paid_by")
    cls = F.when(F.col("paid_by").isNotNull(), "settled").when(F.col("_unclear"), "inconclusive").otherwise("unsettled")
    return told.select(key, "id", "amount", "n_entries", cls.alias("class"), "paid_by")
