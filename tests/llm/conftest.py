import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def prose():
    """Invented words, the same for every seed."""
    import random

    def make(seed, n, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))
    return make


def with_clashes(docs):
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("text_key", "kept", "id", "a", "b", "n", "removed", "row", "component", "name", "h1", "n_tokens", "_r_id", "topic", "ratio"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
