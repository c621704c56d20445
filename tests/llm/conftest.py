import pytest


@pytest.fixture(scope="session")
def make(spark):
    """documents-like frames from (doc_id, text[, lang, source]) rows, with an extra column of a clashing name."""

    def f(rows, extra=True):
        rows = [(r + ("en", "s"))[: max(4, len(r))] if len(r) < 4 else r for r in map(tuple, rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        from pyspark.sql import functions as F

        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumn("key", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("size", F.lit(2)) if extra else df

    return f
