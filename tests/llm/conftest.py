import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, "
           "n_chars long")
#: Names that operators use inside; input columns may carry them too.
EXTRA = ("kept", "id", "key", "n", "digest", "tag", "component", "sketch",
         "shard", "range", "size", "ids", "score", "label", "copy", "row")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text) rows, with columns that clash."""
    def make(rows):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(
            [(i, t, None if t is None else "en", None,
              None if t is None else len(t)) for i, t in rows], COLUMNS)
        return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    base = " ".join(f"w{i * i % 977}" for i in range(160))
    near = base.replace(" w1 ", " other ", 1)
    return [(5, None), (3, ""), (4, " \t\n "), (9, "one two  three"),
            (2, "one two three"), (2, "one two three"), (7, "One two three"),
            (1, base), (8, base), (6, near), (None, base), (None, None),
            (12, "x " * 30_000), (11, "x " * 30_000 + "y"),
            (13, "tail " + base + " end"), (14, "é" * 40 + " naïve ▁ 漢字"),
            (10, base + " " + base)]
