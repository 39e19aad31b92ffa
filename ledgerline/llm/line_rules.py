"""Quality rules: measures of each text, and the frequency of its lines across a host's documents.

Lines are normalised (A-Z lower-cased, digits as 0, white space collapsed) and
hashed. A line that stands in more than `limit` documents of a host is
boilerplate there. A document that loses nearly all its words with its
boilerplate is depleted and rejected, beside those that fail the base rules. But copying a document doesn't make
boilerplate of all its lines: documents that would be depleted and are copies, or near copies, of one another
count as one, and lines that are then within the limit stay.

Null texts have no words and fail; a null host (source) is a host of its own;
rows without doc_id are judged like others, and rows that repeat one another alike. An
empty table gives an empty result. A task holds the measures of a thousand texts at a time,
whatever their length. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WHITE, checkpointed, slices, text_hashes
from ledgerline.llm.ngram_join import flagged, ngram_jaccard_join

#: Documents of a host that a line may stand in; words that have to be left, and percent of all words.
LINE_LIMIT, LEAST_LEFT, LEAST_LEFT_PERCENT = 20, 20, 10
#: Base rules: fewest words, highest percent of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3

#: Lines with more than this part of all lines of all documents; there are fewer than so many.
HOT_LINES = 1024

#: Depleted texts with this similarity (percent) of their sets of shingles, or more, count a line once.
COPY_WIDTH, COPY_PERCENT = 5, 50
#: Depleted texts whose hashes are broadcast (16 bytes each); more of them are joined, a text's copies in so many parts.
BROADCAST_TEXTS, PARTS = 1 << 18, 16

SYMBOLS = "#*$%&|<>"
_ZERO = bytes.maketrans(b"123456789", b"0" * 9)

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_hash(line: bytes) -> int:
    """Hash of a line's normal form; 0 for a line without a word."""
    words = line.lower().translate(_ZERO).split()
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else 0


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of `WINDOW` words that the text has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    window = at[: n - WINDOW + 1]
    for i in range(1, WINDOW):
        # Renumbered at each step, so that no number outgrows 64 bits.
        window = np.unique(window * len(ids) + at[i : n - WINDOW + 1 + i], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(n, bool)
    for i in range(WINDOW):
        covered[i : n - WINDOW + 1 + i] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _host(source: F.Column) -> F.Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _measured(docs: DataFrame) -> DataFrame:
    """Measures of each row, a number of its own, its host and text hash, and its lines' hashes and words."""

    def measure(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            rows = [measures(t) for t in texts]
            lines = []
            for t in texts:
                found, seen = [(line_hash(x), len(x.split())) for x in (t or "").encode().split(b"\n")], set()
                lines.append([{"hash": h, "words": n, "first": not (h in seen or seen.add(h))} for h, n in found if n])
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64()), ("first", pa.bool_())]))
            names = ["doc_id", "host", *(x.split()[0] for x in _MEASURES.split(", ")), "t1", "t2", "lines"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns, batch.column("t1"), batch.column("t2"), pa.array(lines, kind)], names)

    text = F.col("text").cast("string")
    t1, t2 = text_hashes(text)
    rows = docs.select(F.col("doc_id").cast("long"), _host(F.col("source")).alias("host"), text, t1.alias("t1"), t2.alias("t2"))
    return rows.mapInArrow(measure, f"doc_id long, host string, {_MEASURES}, t1 long, t2 long, lines array<struct<hash: long, words: long, first: boolean>>").withColumn("row", F.monotonically_increasing_id())


def _depleted(left: F.Column) -> F.Column:
    return (left < LEAST_LEFT) | (100 * left < LEAST_LEFT_PERCENT * F.col("n_words"))


def _copies(docs: DataFrame, depleted: DataFrame) -> DataFrame:
    """(t1, copies_of) of the texts that are depleted: those that are near copies of one another have one copies_of."""
    t1, t2 = text_hashes(F.col("text").cast("string"))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col("text").cast("string"))
    if depleted.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(depleted), ["t1", "t2"], "left_semi")
    else:
        # A text's copies meet the text's hashes in several tasks, and are combined before they meet one another.
        salted = depleted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        texts = texts.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).join(salted, ["t1", "t2", "_part"], "left_semi")
    once = checkpointed(texts.groupBy("t1", "t2").agg(F.first("text").alias("text")))
    groups = ngram_jaccard_join(once.select(F.col("t1").alias("doc_id"), "text"), COPY_WIDTH, COPY_PERCENT)
    return groups.select(F.col("doc_id").alias("t1"), F.col("component_id").alias("copies_of"))


def _beyond_copies(docs: DataFrame, rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The lines of `found`, which are frequent, that stay so when depleted texts that are near copies count once."""
    lost = found.groupBy("row").agg(F.sum("words").alias("lost"))
    depleted = checkpointed(rows.join(lost, "row").where(_depleted(F.col("n_words") - F.col("lost"))).select("t1", "t2").distinct())
    by_text = found.where("first").groupBy("host", "hash", "t1").agg(F.count("*").alias("docs")).join(checkpointed(_copies(docs, depleted)), "t1", "left")
    by_group = by_text.groupBy("host", "hash", "copies_of").agg(F.sum("docs").alias("docs"))
    counted = by_group.groupBy("host", "hash").agg(F.sum(F.when(F.col("copies_of").isNull(), F.col("docs")).otherwise(1)).alias("n"))
    return checkpointed(counted.where(F.col("n") > limit))


def _among(lines: DataFrame, frequent: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of `lines` whose (host, hash) is among `frequent`.

    Lines so common that one task would have too many are compared with a
    broadcast of fewer than `HOT_LINES` rows; the others meet by shuffle.
    """
    of_hot = frequent.join(F.broadcast(hot), ["host", "hash"], "left_semi").select("host", "hash", F.lit(True).alias("stays"))
    told = lines.join(F.broadcast(hot.select("host", "hash", F.lit(True).alias("is_hot"))), ["host", "hash"], "left")
    rest = told.where("is_hot is null").join(frequent.select("host", "hash"), ["host", "hash"], "left_semi")
    return told.where("is_hot").join(F.broadcast(of_hot), ["host", "hash"], "left_semi").drop("is_hot").unionByName(rest.drop("is_hot"))


def line_frequency_rules(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """doc_id, host, measures, base_failed, kept, n_left_words, hashes of the text and of the lines to remove, for each row."""
    rows = checkpointed(_measured(docs))
    lines = rows.select("row", "host", "t1", F.inline("lines"))
    # Combined before its shuffle.
    counted = lines.groupBy("host", "hash").agg(F.count(F.when(F.col("first"), 1)).alias("n"), F.count("*").alias("rows"))
    frequent = checkpointed(counted.where(F.col("n") > limit))
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    hot = checkpointed(frequent.where(F.col("rows") * HOT_LINES > total).select("host", "hash"))
    lines = checkpointed(_among(lines, frequent, hot))
    lines = _among(lines, _beyond_copies(docs, rows, lines, limit), hot)
    removed = lines.groupBy("row").agg(F.sum("words").alias("lost"), F.array_sort(F.collect_set("hash")).alias("removed_lines"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    base_failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words")
    depleted = _depleted(left)
    return rows.join(removed, "row", "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
        left.alias("n_left_words"), "t1", "t2", F.coalesce("removed_lines", F.expr("array()").cast("array<long>")).alias("removed_lines"),
    )


def without_lines(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """The kept rows of `docs`, all their columns, with frequent lines taken out of text (and n_chars, where there is one).

    Verdicts are those of doc_id, host and text, so repeated rows stay repeated.
    """

    def strip(batches):
        for batch in slices(batches):
            rows = batch.column("doc")
            kept = []
            for text, gone in zip(rows.field("text").to_pylist(), batch.column("removed_lines").to_pylist(), strict=True):
                gone = set(gone or ())
                kept.append("\n".join(x for x in text.split("\n") if line_hash(x.encode()) not in gone) if gone and text else text)
            changed = {"text": pa.array(kept, pa.string())}
            if rows.type.get_field_index("n_chars") >= 0:
                changed["n_chars"] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(rows.type.field("n_chars").type)
            names = [f.name for f in rows.type]
            doc = pa.StructArray.from_arrays([changed.get(n, rows.field(i)) for i, n in enumerate(names)], names)
            yield pa.RecordBatch.from_arrays([doc], ["doc"])

    verdicts = line_frequency_rules(docs, limit).where("not kept or size(removed_lines) > 0")
    changed = checkpointed(verdicts.groupBy("doc_id", "host", "t1", "t2").agg(F.first("kept").alias("kept"), F.first("removed_lines").alias("removed_lines")))
    # Rows that stay as they are, nearly all but those that go or lose lines, aren't shuffled; of the others each goes
    # whole, as one column, so that no column of it can clash with ours.
    told = flagged(docs, changed.select("doc_id", "t1", "t2"))
    verdict = changed.select("doc_id", "host", F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "kept", "removed_lines")
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (_host(F.col("doc.source")) == F.col("host")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    joined = told.where("possible").join(verdict, same, "left").where("coalesce(kept, true)").select("doc", "removed_lines")
    stripped = joined.mapInArrow(strip, told.select("doc").schema)
    return told.where("not possible").select("doc").union(stripped).select("doc.*")


_N = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = rf"""
with recursive docs as (
  select row_number() over () as row_no, doc_id, coalesce(text, '') as text, coalesce('+' || source, '-') as host from documents
), words as (
  select row_no, unnest(regexp_extract_all(text, '{_N}')) as word, generate_subscripts(regexp_extract_all(text, '{_N}'), 1) as i from docs
), windows as (
  select row_no, i, word || ' ' || lead(word) over w || ' ' || lead(word, 2) over w as three from words window w as (partition by row_no order by i)
), twice as (
  select row_no, i from (select row_no, i, count(*) over (partition by row_no, three) as n from windows where three is not null) where n > 1
), repeats as (
  select row_no, count(distinct j) as n from (select row_no, i as j from twice union all select row_no, i + 1 from twice union all select row_no, i + 2 from twice) group by row_no
), lines as (
  select row_no, host, text, unnest(string_split(text, chr(10))) as line from docs
), full_lines as (
  select row_no, host, text, line, len(regexp_extract_all(line, '{_N}')) as n,
    regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')), '^ | $', '', 'g') as norm
  from lines where regexp_matches(line, '{_N}')
), often as (
  select host, norm from full_lines group by host, norm having count(distinct row_no) > {LINE_LIMIT}
), sizes as (
  select row_no, text, len(regexp_extract_all(text, '{_N}')) as n_words from docs
), hollow as (
  select distinct text, md5(text) as t from (select row_no, sum(n) as lost from full_lines join often using (host, norm) group by row_no) join sizes using (row_no)
  where n_words - lost < {LEAST_LEFT} or 100 * (n_words - lost) < {LEAST_LEFT_PERCENT} * n_words
), hollow_words as (
  select t, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_N}') as w from hollow
), shingles as (
  select distinct t, unnest(list_transform(range(1, greatest(1, len(w) - {COPY_WIDTH - 1}) + 1), lambda i: array_to_string(w[i:i + {COPY_WIDTH - 1}], ' '))) as s from hollow_words
), set_sizes as (
  select t, count(*) as n from shingles group by t
), alike as (
  select x.t as a, y.t as b from shingles x join shingles y on x.s = y.s and x.t <> y.t join set_sizes p on p.t = x.t join set_sizes q on q.t = y.t
  group by x.t, y.t, p.n, q.n having 100 * count(*) >= {COPY_PERCENT} * (p.n + q.n - count(*))
), reached as (
  select t, t as other from hollow union select r.t, b from reached r join alike on r.other = a
), copies as (
  select t, min(other) as copies_of from reached group by t
), frequent as (
  select host, norm from full_lines join often using (host, norm) left join copies on md5(text) = copies.t group by host, norm having count(distinct coalesce(copies_of, cast(row_no as varchar))) > {LINE_LIMIT}
), lost as (
  select row_no, sum(n) as n from full_lines join frequent using (host, norm) group by row_no
), dups as (
  select row_no, count(*) - count(distinct line) as n from full_lines group by row_no
), measured as (
  select doc_id, len(regexp_extract_all(text, '{_N}')) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, coalesce(lost.n, 0) as lost
  from docs left join dups using (row_no) left join repeats using (row_no) left join lost using (row_no)
), judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed, n_words - lost as n_left from measured
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and n_left >= {LEAST_LEFT} and 100 * n_left >= {LEAST_LEFT_PERCENT} * n_words as kept, cast(n_left as bigint) as n_left_words
from judged
"""
