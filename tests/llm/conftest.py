import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from rows; ``more`` adds columns whose names clash with those that operators use inside."""
    def make(rows, more=False):
        df = spark.createDataFrame(rows, SCHEMA)
        if more:
            for name in ("uid", "block", "hash", "node", "label", "kept", "size", "seed", "shard", "_row", "quality_features"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return rows
