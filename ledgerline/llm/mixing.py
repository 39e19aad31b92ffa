"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most `most` times its
own words; what it can't take is shared anew among the others. A source gives
complete epochs first. What is left of its target is a sample without
replacement: each document draws an exponential key, scaled by its quality, and
documents are taken by ascending key until the budget is met.

Keys are drawn from the doc_id by hash, so reruns agree. Keys are sorted and
summed over ranges of (source, key) of even size; no source needs one task.

A null or empty text has no words and is taken 0 times; a null source is a
source of its own, last in order; repeated rows count as documents of their own; a row
without doc_id draws its key from its text. Very long texts are taken like others, in part where
a budget ends within one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, shuffle_partitions, word_count

WEIGHTS, MOST_EPOCHS, SEED = (5, 2, 1), 3, "mix"
SYMBOLS = "#*$%&|<>"
#: Sources whose targets are broadcast; more of them are joined by shuffle, the rows of each in so many parts.
BROADCAST_SOURCES, PARTS = 10_000, 16
#: Repetitions of one row that a task writes.
AT_ONCE = 256


def running_total(df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """`df` with, for each of `values`, its sum over the group's rows before (`before_<value>`).

    Rows are dealt by ranges of (group, order) and summed within each; one row
    for each range and group is then summed across ranges. `df` should be cheap to
    read twice, and `order` should tell rows apart or their order is free.
    """
    n = shuffle_partitions(df.sparkSession)
    parts = checkpointed(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, *[F.coalesce(F.sum(f"_sum_{v}").over(across), F.lit(0)).alias(f"_start_{v}") for v in values])
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{v}") for v in values])
    joined = summed.join(starts, ["_part", *group])
    return joined.select(*df.columns, *[(F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])


def repeats(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`df` with `repeat`: the number of rows with the same key (a long, not null) before a row, in `order`; 0 of most rows.

    Numbers are made over ranges, so a key with a third of all rows is many tasks' work.
    `df` should be written, for rows are told apart by where they stand.
    """
    told = df.withColumns({"_row": F.monotonically_increasing_id(), "_one": F.lit(1)})
    return running_total(told, [key], [*order, "_row"], ["_one"]).withColumnRenamed("before__one", "repeat").drop("_row", "_one")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(place, source_size, target) of each source (place, source_size); weights go by ascending place."""
    listed = running_total(sources.withColumn("one", F.lit(1)), [], ["place"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long")
    # With sources in order of the level at which they are full, those that end up full come first.
    weighed = checkpointed(listed.select("place", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("full"), (F.col("source_size") * most / weight).alias("level")))
    total, weight_sum = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    levels = running_total(weighed, [], ["level", "place"], ["full", "weight"])
    rest, of_weight = F.lit(total) - F.col("before_full"), F.lit(weight_sum) - F.col("before_weight")
    fits = F.col("full").cast("double") * of_weight >= rest.cast("double") * F.col("weight")
    found = levels.where(fits).agg(F.min_by(F.struct(rest.alias("rest"), of_weight.alias("weight")), F.struct("level", "place")).alias("x")).first()["x"]
    rest, of_weight = (found["rest"], found["weight"]) if found else (0, 1)
    target = F.least((F.col("weight") * F.lit(rest)).cast("double") / F.lit(of_weight), F.col("full").cast("double"))
    return weighed.select("place", "source_size", target.alias("target"))


def _place(source: F.Column) -> F.Column:
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _drawing(docs: DataFrame, *more: F.Column) -> DataFrame:
    """doc_id, place (of its source), size, text_hash and the exponential key of each row, and `more` columns."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    size = word_count(text)
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    name = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    quality = (size + 1) / (size + 1 + symbols)
    return docs.select(*more, doc_id.alias("doc_id"), _place(F.col("source")).alias("place"), size.alias("size"), F.xxhash64(text).alias("text_hash"), (-F.log(uniform) / quality).alias("key"))


def _with_place(rows: DataFrame, by_place: DataFrame) -> DataFrame:
    """`rows` with the row of `by_place` (written, one for each source) of their place; a source's rows are not brought together."""
    if by_place.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(by_place), "place")
    salted = by_place.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).join(salted, ["place", "_part"]).drop("_part")


def _drawn(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Each row with its source's size and target, complete epochs and the words left for its sample, and the words drawn before it."""
    # Rows that repeat one another are told apart, so that ranges can end between them.
    rows = checkpointed(_drawing(docs)).withColumn("row", F.monotonically_increasing_id())
    sources = checkpointed(rows.groupBy("place").agg(F.sum("size").alias("source_size")))
    targets = checkpointed(source_targets(sources, weights, most))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    drawn = _with_place(running_total(rows, ["place"], ["key", "doc_id", "text_hash", "row"], ["size"]), targets).withColumn("epochs", epochs)
    return drawn.withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))


#: Of a document taken whole if more than half of it is within the budget: true for those before the edge, false after it.
_WITHIN = "2 * before_size + size <= 2 * budget"


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, cut: bool = True) -> DataFrame:
    """doc_id, place (of its source), text_hash, size, source_size, target and taken (words, repeats counted) of each row.

    With `cut`, the document on a budget's edge gives only its first words, and
    sources meet their targets to the word; without, it is taken whole if more
    than half of it is within.
    """
    if cut:
        more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before_size")))
    else:
        more = F.when(F.expr(_WITHIN), F.col("size")).otherwise(0)
    return _drawn(docs, weights, most).select("doc_id", "place", "text_hash", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """`docs`, each row as many times as the mix takes it whole.

    A source's sample ends at one place in the order of keys, and a row draws its key from itself: so texts are
    compared with their source's edge where they are read, and not shuffled. Of rows that repeat
    one another on the edge, some of which are within, one stands for all that are.
    """
    drawn = _drawn(docs, weights, most).where("size > 0")
    order = F.struct("key", "doc_id", "text_hash")
    within = F.expr(_WITHIN)
    edges = checkpointed(drawn.groupBy("place").agg(F.first("epochs").cast("long").alias("epochs"), F.max(F.when(within, order)).alias("last"), F.min(F.when(~within, order)).alias("next")))
    on_edge = F.col("last") == F.col("next")
    rows = _with_place(_drawing(docs, F.struct("*").alias("doc")).where("size > 0").withColumn("at", order), edges)
    more = F.coalesce(F.when(on_edge, F.col("at") < F.col("last")).otherwise(F.col("at") <= F.col("last")), F.lit(False))
    takes = F.col("epochs") + more.cast("long")
    each = rows.withColumn("takes", takes).where("takes > 0").select("doc", F.explode(F.expr("sequence(1L, takes)"))).select("doc")
    ends = checkpointed(edges.where(on_edge).select("place", F.col("last").alias("edge")))
    if not ends.isEmpty():
        split = checkpointed(_with_place(drawn.withColumn("at", order), ends).where((F.col("at") == F.col("edge")) & within).groupBy("place", "edge").agg(F.count("*").alias("n")))
        # Any of the rows will do; they are combined before the shuffle.
        one = _with_place(rows.select("doc", "place", "at"), split).where(F.col("at") == F.col("edge")).groupBy("place").agg(F.first("doc").alias("doc"), F.first("n").alias("n"))
        dealt = one.select("doc", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {AT_ONCE})")).alias("part")).repartition(shuffle_partitions(docs.sparkSession))
        each = each.union(dealt.select("doc", F.explode(F.expr(f"sequence(1L, least({AT_ONCE}L, n - part * {AT_ONCE}))"))).select("doc"))
    return each.select("doc.*")


ORACLE_SQL = rf"""
with docs as (
  select doc_id, coalesce('0' || source, '1') as place, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as symbols,
    (('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 13))::bigint::double + 1) / {1 << 52}.0 as uniform
  from documents
), sources as (
  select place, cast(sum(size) as bigint) as source_size, case (row_number() over (order by place) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from docs group by place
), levels as (
  select *, {MOST_EPOCHS} * source_size as filled, sum(source_size) over () - coalesce(sum({MOST_EPOCHS} * source_size) over before, 0) as rest, sum(weight) over () - coalesce(sum(weight) over before, 0) as of_weight,
    row_number() over (order by {MOST_EPOCHS} * source_size / weight, place) as i
  from sources window before as (order by {MOST_EPOCHS} * source_size / weight, place rows between unbounded preceding and 1 preceding)
), level as (
  select rest, of_weight from levels where filled * of_weight >= rest * weight order by i limit 1
), targets as (
  select place, source_size, least(cast(weight * rest as double) / cast(of_weight as double), cast({MOST_EPOCHS} * source_size as double)) as target from sources, level
), budgets as (
  select *, cast(floor(target / source_size) as bigint) as epochs from targets where source_size > 0 union all select *, 0 from targets where source_size = 0
), drawn as (
  select doc_id, size, place, coalesce(sum(size) over (partition by place order by -ln(uniform) / ((size + 1.0::double) / (size + 1 + symbols)), doc_id rows between unbounded preceding and 1 preceding), 0) as before from docs
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * source_size - before)) as bigint) as taken
from drawn join budgets using (place)
"""
