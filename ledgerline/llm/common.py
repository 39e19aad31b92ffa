"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.shared import checkpointed, shared_folder, shuffle_partitions

__all__ = ["A_TO_Z", "WHITE", "WORD", "WordHashes", "as_bytes", "ascii_lower", "checkpointed", "mixed", "shared_folder", "shuffle_partitions", "signed", "slices", "table", "text_hashes", "word_count"]

#: ASCII white space as the contracts define it: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CACHED_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Words of the whole text, a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text) -> F.Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def text_hashes(text: F.Column) -> tuple[F.Column, F.Column]:
    """128 bits that tell texts apart, as two longs; null is apart from all text."""
    return F.xxhash64(text, text.isNull()), F.xxhash64(F.lit("second"), text)


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets what it has when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in parts of few rows: what Python makes of one is freed before the next.

    What Arrow has freed goes back to the system at the end, for the worker lives on.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text of an Arrow string column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
