import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tillwork.session import build_session

    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield session


@pytest.fixture
def small_blocks(spark):
    """Cut files into blocks of a few lines, so that the operators over line order have to carry state between blocks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
