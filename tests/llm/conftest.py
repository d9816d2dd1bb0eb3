import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang) rows,
    with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            for c in ("id", "th", "row", "block", "score", "key", "html", "begin", "class"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
