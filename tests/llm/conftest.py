import pytest
from pyspark.sql import types as T

#: Rows that every operator has to take: nulls, empty and blank texts, repeated rows, a long text.
EDGE_TEXTS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (None, "one two three four five six seven eight nine ten"),
    (6, "word " * 3000),
    (7, "Grüße aus Köln. Ça va? ¡Hola! 你好 \U0001f600"),
]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("_row", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """Documents with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "x", None, 9) for i, t in rows], DOCS)

    return make


@pytest.fixture
def edge_docs(docs_of):
    return docs_of(EDGE_TEXTS)


@pytest.fixture
def no_docs(docs_of):
    return docs_of([])
