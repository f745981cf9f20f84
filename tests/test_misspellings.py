"""That misspellings of configured stopwords are told by bytes, as the queries' SQL tells them."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


@pytest.fixture
def turns(tmp_path, monkeypatch):
    """Words one letter of one or two bytes away from stopwords, a swap of neighbours, and letters of several bytes elsewhere."""
    texts = ["ßein und hauß", "einß seich sichh snich", "łein eøine dłas strøm", "niхt пара und-ß x-ßein", "qeu ahora daß für nihct", "中que 中文字 cafés œuvre"]
    columns = {"conv_id": list(range(0, 50 * len(texts), 50)), "turn": [0] * len(texts), "role": ["user"] * len(texts), "text": texts}
    pq.write_table(pa.table(columns), f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(oracle, "TABLES", ["conversations"])
    return str(tmp_path)


@pytest.mark.parametrize("name", ["keyword_extract", "keyword_forms"])
def test_letters_of_two_bytes_are_two_edits(spark, turns, name):
    assert oracle.compare(spark, turns, name).endswith("equal")
