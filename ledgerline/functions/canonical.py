"""Canonical encodings of rows, and digests of rows and of whole tables."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of a row's hash that make one lane of a table's digest, and lanes.
LANE, LANES = 15, 4


def normalised_key(column: Column) -> Column:
    """A key as it is compared: trimmed, lower case, runs of other than letters, marks and digits of any script as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^\p{L}\p{M}\p{N}]+", "-"), r"^-+|-+$", "")


#: Types whose cast to string tells all values apart and depends on no setting.
_PLAIN = (T.StringType, T.IntegralType, T.DecimalType, T.BooleanType, T.DateType)


def _text(value: Column, kind: T.DataType) -> Column:
    """A value that isn't null as text; nested values are encoded one by one."""
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampType):
        # An instant, whatever the session's zone.
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _encoded(x, kind.elementType)), "|"), F.lit("]"))
    if isinstance(kind, T.MapType):
        entry = lambda e: _escaped(F.concat_ws("|", _encoded(e["key"], kind.keyType), _encoded(e["value"], kind.valueType)))
        return F.concat(F.lit("<"), F.array_join(F.array_sort(F.transform(F.map_entries(value), entry)), "|"), F.lit(">"))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws("|", *[_encoded(value[f.name], f.dataType) for f in kind]), F.lit("}")))
    if isinstance(kind, _PLAIN):
        return value.cast("string")
    raise TypeError(f"values of type {kind.simpleString()} have no canonical text; cast floating-point values to decimal first")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))


def _encoded(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(F.concat(F.lit("="), _escaped(_text(value, kind))), F.lit("~"))


def encoded(column: str, kind: T.DataType) -> Column:
    """A value as text that no other value of its type has.

    Nulls are apart from all text, separators are escaped, and elements of arrays, maps
    (in order of their keys' text) and structs are encoded in the same way.
    """
    return _encoded(F.col(f"`{column}`"), kind)


def canonical_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's canonical text, columns in the given order (by name unless given)."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat_ws("|", *[encoded(c, kinds[c]) for c in columns or sorted(kinds)])


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(canonical_row(df, columns), 256)


def lanes(row_hash: Column) -> list[Column]:
    """A hash's hex digits as numbers whose sums combine."""
    return [F.conv(F.substring(row_hash, 1 + LANE * i, LANE), 16, 10).cast("decimal(20,0)") for i in range(LANES)]


def _summed() -> list[Column]:
    return [F.count("*").alias("n_rows"), *[F.sum(lane).cast("decimal(38,0)").alias(f"s{i}") for i, lane in enumerate(lanes(F.col("h")))]]


def _digest() -> Column:
    return F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(LANES)]), 256)


def digest_of_nothing() -> str:
    """The digest of a table without rows."""
    return sha256("|".join(["0"] * (1 + LANES)).encode()).hexdigest()


def grouped_digests(df: DataFrame, by: str, row: str | None = None) -> DataFrame:
    """(by, n_rows, digest): one row for each value of `by`, over the struct column `row`'s fields or all other columns."""
    fields = df.select(f"{row}.*").columns if row else [c for c in df.columns if c != by]
    rows = df.select(F.col(by).alias("_by"), F.struct(*[F.col(f"{row}.`{c}`" if row else f"`{c}`") for c in fields]).alias("_row"))
    hashed = rows.select("_by", canonical_struct(rows, "_row").alias("h"))
    return hashed.groupBy(F.col("_by").alias(by)).agg(*_summed()).select(by, "n_rows", _digest().alias("digest"))


def canonical_struct(df: DataFrame, column: str) -> Column:
    """The hash of a struct column's fields, as row_hash gives it for a row of them."""
    fields = {f.name: f.dataType for f in df.schema[column].dataType}
    return F.sha2(F.concat_ws("|", *[_encoded(F.col(column)[name], fields[name]) for name in sorted(fields)]), 256)


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, n_rows, digest): for each table one row that depends on its rows, repeats included, and not on their order.

    Lanes of the row hashes are summed, so that partial sums combine and no
    task collects rows; all tables are read in one job.
    """
    hashed = None
    for part, df in tables.items():
        one = df.select(F.lit(part).alias("part"), row_hash(df).alias("h"))
        hashed = one if hashed is None else hashed.union(one)
    sums = hashed.groupBy("part").agg(*_summed())
    parts = F.explode(F.array(*[F.lit(p) for p in tables])).alias("part")
    all_sums = hashed.sparkSession.range(1).select(parts).join(sums, "part", "left")  # a table without rows has a digest too
    filled = [F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *[F.coalesce(f"s{i}", F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(LANES)]]
    return all_sums.select("part", *filled).select("part", "n_rows", _digest().alias("digest"))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, digest) of one table, of the given columns."""
    return table_digests({"table": df.select(*columns) if columns else df}).drop("part")
