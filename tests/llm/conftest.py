import pytest
from pyspark.sql import types as T

from reviewgate.llm.frames import bounded_batches

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
#: Names that operators use for columns of their own.
CLASHING = [
    "id", "fp", "root", "n", "host", "path", "rule", "score", "failed", "measured", "row",
    "shard", "slot", "stratum", "rank", "lang_pred", "payload", "header", "label", "hot", "key",
]


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source, n_chars]) tuples."""
    bounded_batches(spark)

    def make(rows, clashing=False, partitions=3):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        schema = DOCUMENT
        if clashing:
            full = [r + tuple(range(len(CLASHING))) for r in full]
            schema = T.StructType(
                DOCUMENT.fields + [T.StructField(x, T.LongType()) for x in CLASHING]
            )
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture
def pages(spark):
    bounded_batches(spark)

    def make(rows, clashing=False):
        schema = PAGE
        if clashing:
            rows = [tuple(r) + tuple(range(len(CLASHING))) for r in rows]
            schema = T.StructType(PAGE.fields + [T.StructField(x, T.LongType()) for x in CLASHING])
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose(sf):
    """Real texts to build fixtures from."""
    import duckdb

    return [
        x
        for (x,) in duckdb.sql(
            f"SELECT text FROM '{sf}/documents.parquet' WHERE length(text) > 600 ORDER BY doc_id"
        ).fetchall()
    ]
