import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]


@pytest.fixture(scope="session")
def docs(spark):
    from fixtures import SCHEMA, awkward

    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def table(docs, tmp_path_factory):
    """A folder with the awkward documents."""
    root = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.fixture(scope="session")
def nothing(spark, docs, tmp_path_factory):
    """A folder with empty tables."""
    root = tmp_path_factory.mktemp("none")
    docs.limit(0).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)
