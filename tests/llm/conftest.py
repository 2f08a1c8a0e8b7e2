import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds documents from `(doc_id, text)` or `(doc_id, text, lang, source)`, with one more
    column, whose name the operators might want for themselves."""

    def build(*rows, extra="row"):
        full = [
            (*r, *((None, "s") if len(r) == 2 else ()), len(r[1] or "")) for r in rows
        ]
        from pyspark.sql import functions as F

        return spark.createDataFrame(full, DOCUMENTS).withColumn(extra, F.lit("x"))

    return build

