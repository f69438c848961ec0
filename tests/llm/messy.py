"""Small tables with everything that can go wrong in them."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["bucket", "key", "h1", "w", "places", "band", "toxic", "quality", "__gone", "score", "vec_id", "embedding"]

PASSAGE = "first line of the shared passage here\nsecond line of it goes on\nthird line of the shared passage ends"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(40_000))


def rows():
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (3, "alpha beta gamma delta epsilon zeta eta iota", "en", None, 1),
        (4, "", "en", "b", 0),
        (5, None, None, "b", None),
        (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
        (None, None, None, None, None),
        (6, "one", "en", "b", 3),
        (7, "one", "en", "b", 3),
        (8, LONG, "en", "c", len(LONG)),
        (9, LONG + " tail", "en", "c", 1),
        (10, f"{PASSAGE}\nown text of ten", "en", "a", 1),
        (11, f"before it\n\n {PASSAGE} \nafter it", "en", "a", 1),
        (12, f"{PASSAGE}\n{PASSAGE}\n", "de", "a", 1),
        (13, "  \n\t\n ", "de", "a", 1),
        (14, "ÀÉ straße ñandú 漢字 \U0001f600 é don't we'll 1234 ...", "de", "c", 1),
        (15, "  x\r\ny", "de", "c", 1),
    ]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHES})


def labels(spark, data=None):
    data = [(1, 1, 0), (1, None, None), (3, 0, 0), (None, 1, 1), (8, None, None), (999, 1, 1), (10, 1, 0)] if data is None else data
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
