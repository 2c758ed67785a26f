import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns no operator knows, some with names that operators use inside.
CLASHES = ["kept", "component", "node", "_key", "ids", "n_words", "verdict", "_gone", "_spans", "ref_id"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts (or of (doc_id, text) pairs), with clashing extra columns."""

    def make(texts, partitions=3):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(pairs)]
        frame = spark.createDataFrame(rows, T.StructType.fromDDL(DOCS)).repartition(partitions)
        return frame.selectExpr("*", *[f"'x' AS `{name}`" for name in CLASHES])

    return make


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
