import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """rows -> DataFrame of documents with columns whose names clash with the operators' own."""

    def make(rows, schema="doc_id long, text string", extra=True):
        df = spark.createDataFrame(rows, schema)
        if not extra:
            return df
        from pyspark.sql import functions as F

        return df.withColumns({"k": F.lit("x"), "key": F.lit(1), "score": F.lit("s"), "kept": F.lit(0), "spans": F.lit(2), "rank": F.lit(9)})

    return make
