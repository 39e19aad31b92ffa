import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = """row host key size component node target shard slot cluster features lexicon bits word words place doc possible gone vector raw probability prediction p calibrated score
toxic text_hash removed_lines kept copies taken col at _text _doc_id _id _part half calibrates block unit rep links""".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text, source) rows; with `clashing`, other columns too."""

    def make(rows, clashing=False):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
        return df

    return make


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, long, "a"), (7, long, None), (8, "same text here " * 40, "c"), (8, "same text here " * 40, "c"), (None, "no id at all here", "c"), (None, None, None), (9, "Ünïcode ␛ 𝔘 text\n\nwith lines\nwith lines", "é"),
    ]
