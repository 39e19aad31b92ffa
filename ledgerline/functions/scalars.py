"""Scalar helpers for records of outside origin: safe typing, fields of JSON, calendar fields, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(column: Column, kind: str, otherwise: object = None) -> Column:
    """A value cast to `kind`; what can't be cast, and null, becomes `otherwise`."""
    value = column.try_cast(kind)
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise).cast(kind))


def json_text(column: str, field: str) -> Column:
    """A top-level field of a JSON object as text; null where there is none or no object."""
    return F.get_json_object(column, f"$.{field}")


def json_field(column: str, field: str, kind: str) -> Column:
    """A top-level field of a JSON object by type; null where it is of another."""
    return F.from_json(column, f"{field} {kind}")[field]


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def month_end(ts: Column) -> Column:
    """The first moment of the month's last day."""
    return month_start(ts) + F.expr("interval 1 month") - F.expr("interval 1 day")


def day_of_month(ts: Column) -> Column:
    """Days since the month began, from 0."""
    return F.datediff(ts, month_start(ts))


def sum_above(values: str, least: int) -> Column:
    """The sum of an array's whole numbers above `least`."""
    return F.aggregate(F.filter(values, lambda x: x > least), F.lit(0).cast("long"), lambda s, x: s + x)


def joined_text(values: str, change, separator: str = ",") -> Column:
    """An array's elements, each after `change`, as one text."""
    return F.array_join(F.transform(values, lambda x: change(x).cast("string")), separator)


def counts_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, counts, n): of each key the number of rows with each value as a map, and of all. Rows are counted before they meet by key."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(value, "n"))).alias("counts"), F.sum("n").alias("n"))


def looked_up(counts: str, value: str) -> Column:
    """A count of such a map, 0 for what it doesn't have."""
    return F.coalesce(F.try_element_at(counts, F.lit(value)), F.lit(0)).cast("long")
