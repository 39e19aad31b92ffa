"""A connector for pages of ledger entries, as a Python data source: spark.read.format("ledger_pages").

Options: `ledgers` (how many), `first` (the first's number), `entries` (in each)
and `seed`. Every split of ledgers is a partition of its own. Entries are made from the seed;
a connector to a live ledger differs in `entries_of` alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ledger long, entry int, account string, amount_units long"


def entries_of(ledger: int, entries: int, seed: int) -> Iterator[tuple[int, int, str, int]]:
    for entry in range(entries):
        drawn = int(md5(f"{seed}:{ledger}:{entry}".encode()).hexdigest()[:12], 16)
        yield ledger, entry, f"ACC-{drawn % 50:04d}", drawn % 1_000_000


class LedgerSplit(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class LedgerReader(DataSourceReader):
    LEDGERS_IN_SPLIT = 100

    def __init__(self, options: dict[str, str]):
        self.first = int(options.get("first", "0"))
        self.end = self.first + int(options.get("ledgers", "10"))
        self.entries, self.seed = int(options.get("entries", "10")), int(options.get("seed", "7"))

    def partitions(self) -> list[LedgerSplit]:
        step = self.LEDGERS_IN_SPLIT
        return [LedgerSplit(i, min(i + step, self.end)) for i in range(self.first, self.end, step)] or [LedgerSplit(0, 0)]

    def read(self, partition: LedgerSplit) -> Iterator[tuple[int, int, str, int]]:
        for ledger in range(partition.first, partition.end):
            yield from entries_of(ledger, self.entries, self.seed)


class LedgerPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LedgerReader:
        return LedgerReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerPages)
