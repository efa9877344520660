"""Small document tables for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


#: Nulls, empties, repeated rows, copies in other case, a null id, a null source, a long text.
ODD = [
    (1, "Alpha beta gamma delta epsilon", "a"),
    (2, "alpha BETA gamma delta epsilon", "b"),
    (2, "alpha BETA gamma delta epsilon", "b"),
    (3, None, None),
    (4, "", "c"),
    (5, "ÀÉ alpha", "a"),
    (6, "àé alpha", None),
    (None, "no id here", "a"),
    (7, "x" * 200_000, "b"),
    (8, "word " * 30_000, "b"),
    (9, "🙂 smile 🙂 and 🙂 more 🙂", "c"),
]


#: Names that the operators make, or could.
MADE = (
    "size digest salt norm raw h g key bucket hot n shard target keep_id fingerprint at piece start length time words copy copies position taken place tie score "
    "_id _raw _lost _place _n _copies _score _doc _key _named _before _at _copy _one _rank _bucket _row _kept _least _size _target _stretch _sum _base _taken"
).split()


def near_name_clashes(df):
    """df with extra columns that are named like those the operators make; each holds its own name."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(name).alias(name) for name in MADE if name not in df.columns])
