import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text), with the columns of documents."""

    def make(texts, lang="en", source="s"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in pairs], DOC)

    return make


@pytest.fixture
def clash():
    """A table with more columns whose names clash with those that operators read or make."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", F.lit("other").alias("TEXT"), F.lit(7).alias("_doc"), F.lit(1).alias("score"), F.lit(2).alias("copies"), F.lit(-5).alias("DOC_ID"))
