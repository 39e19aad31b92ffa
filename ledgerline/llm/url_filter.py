"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Everything here is DataFrame operations. The list's URLs set bits in a Bloom
filter whose blocks are 64-bit words: one hash picks the word, and six groups of
another hash's bits pick bits in it. A page that finds all its bits is a possible hit, and
only possible hits go on to an exact hash join with the list, which takes out
the false ones. The filter's words, and the list's URLs, are broadcast while they are below a
bound, and joined by shuffle beyond.

Null URLs, and those without `://`, have an empty host and path: no rule fits
them and no list holds them. Repeated pages, and those without page_id, are judged alike. Very long
URLs are judged whole. An empty table gives an empty result, and an empty list blocks nothing. Extra
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import A_TO_Z, ascii_lower

#: (host, path, verdict); a rule fits its host and all below it, and paths that begin with its path.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Bits of the filter for each listed URL, bits set, and words up to which it is broadcast (16 bytes each).
BITS_PER_URL, BITS_SET, BROADCAST_WORDS = 16, 6, 1 << 20
#: Bytes of listed URLs up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What is between the first :// and the path, query or fragment, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without .html and closing slashes; null without a host."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")))


def _rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    found = None
    for at, start, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        one = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return found


def _word(url: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(words))


def _bits(url: Column) -> Column:
    h = F.xxhash64(url, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    mask = bit(0)
    for i in range(1, BITS_SET):
        mask = mask.bitwiseOR(bit(i))
    return mask


def bloom_words(listed: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the filter over listed (canonical); words without a bit have no row."""
    return listed.select(_word(F.col("canonical"), words).alias("word"), _bits(F.col("canonical")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; `listed` (canonical) is what no rule has to block."""
    listed = listed.select("canonical").where("canonical is not null").distinct()
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical") + 64), F.lit(0))).first()
    words = 1 << max(4, math.ceil(math.log2(max(1, count * BITS_PER_URL / 64))))
    bloom = bloom_words(listed, words)
    bloom = F.broadcast(bloom) if words <= BROADCAST_WORDS else bloom
    url = F.col("url").cast("string")
    host, path = F.col("host"), F.col("path")
    judged = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"found": _rule(host, path), "canonical": canonical(host, path)})
    open_ = F.col("found").isNull() & F.col("canonical").isNotNull()
    probed = judged.withColumn("at", F.when(open_, _word(F.col("canonical"), words)).otherwise(-1 - F.pmod(F.xxhash64("page_id"), F.lit(words))))
    probed = probed.join(bloom, F.col("at") == F.col("word"), "left").withColumn("possible", F.coalesce(open_ & (F.col("bits").bitwiseAND(_bits(F.col("canonical"))) == _bits(F.col("canonical"))), F.lit(False)))
    columns = ["page_id", "host", "path", F.col("found.rule").alias("rule")]
    if size <= BROADCAST_BYTES:
        exact = listed.select(F.col("canonical").alias("_listed"))
        hits = probed.join(F.broadcast(exact), F.when(F.col("possible"), F.col("canonical")) == F.col("_listed"), "left")
        return hits.select(*columns, F.coalesce("found.verdict", F.when(F.col("_listed").isNotNull(), "block"), F.lit("allow")).alias("verdict"))
    # Pages are read twice, so that only possible hits are shuffled.
    passed = probed.where("not possible").select(*columns, F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))
    exact = listed.withColumn("listed", F.lit(True))
    hits = probed.where("possible").join(exact, "canonical", "left").select(*columns, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    return passed.union(hits)


def toxic_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(canonical): URLs of the pages whose document (the number that ends the path) is labelled toxic."""
    url = F.col("url").cast("string")
    at = canonical(host_of(url), path_of(url))
    numbered = pages.select(at.alias("canonical")).where("canonical is not null").withColumn("doc_id", F.expr("try_cast(nullif(regexp_extract(canonical, '/([0-9]+)$', 1), '') as bigint)"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long")).distinct()
    return numbered.join(toxic, "doc_id", "left_semi").select("canonical").distinct()


_SQL_RULES = "\n    ".join(
    f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h + p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
_SQL_BLOCKED = ", ".join(f"'{h + p}'" for h, p, v in RULES if v == "block")

ORACLE_SQL = rf"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{A_TO_Z}', '{A_TO_Z.lower()}'), '') as host, coalesce(regexp_extract(url, '{_URL}', 2), '') as path from pages
), urls as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') end as canonical,
    case {_SQL_RULES} end as rule
  from parts
), listed as (
  select distinct canonical from urls join labels on try_cast(nullif(regexp_extract(canonical, '/([0-9]+)$', 1), '') as bigint) = doc_id where toxic = 1
)
select page_id, host, path, rule,
  case when rule in ({_SQL_BLOCKED}) then 'block' when rule is not null then 'allow' when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from urls
"""
