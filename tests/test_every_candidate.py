"""That ranking queries take every matching chunk, near by vector or not, as their SQL does."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lodeleaf.operators import augment, rank


@pytest.fixture
def far(tmp_path, monkeypatch):
    """Two questions and 90 chunks, three of which have a vector; most are near copies of each other."""
    rare = {70: "disco alone in russet colours", 80: "nothing to find", 85: "disco clon zebra violet", 89: "Única zebra"}
    texts = [rare.get(i, f"clon disco manual one two three four five six seven eight number{i % 3}") for i in range(90)]
    tables = {
        "documents": {"doc_id": list(range(90)), "text": texts, "lang": ["en"] * 90, "source": ["site" if i in rare else f"src{i % 4}" for i in range(90)]},
        "conversations": {"conv_id": [0, 50], "turn": [0, 0], "role": ["user"] * 2, "text": ["clon disco ordenador", "zebra unica"]},
        "embeddings": {"vec_id": [0, 2, 50], "embedding": pa.array([[0.0, 1.0], [2.0, 1.0], [50.0, 1.0]], pa.list_(pa.float32()))},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(oracle, "TABLES", list(tables))
    return str(tmp_path)


def test_strong_and_score_of_chunks_without_vectors(spark, far):
    rows = entry.queries()["strong_and_score"](spark, far).collect()
    assert sorted(r["chunk_id"] for r in rows if r["qid"] == 0) == [i for i in range(90) if i not in (80, 89)]
    assert oracle.compare(spark, far, "strong_and_score").endswith("equal")


def test_prioritize_dedup_of_chunks_without_vectors(spark, far):
    """The first candidates are near copies of one; others come after many of them."""
    rows = entry.queries()["prioritize_dedup"](spark, far).collect()
    assert {r["chunk_id"] for r in rows if r["qid"] == 0} >= {70, 85}
    assert oracle.compare(spark, far, "prioritize_dedup").endswith("equal")


def test_coverage_ratio_of_chunks_without_vectors(spark, far):
    """Chunk 89 alone holds "zebra" beside "unica" with an accent, which coverage keeps; no vector leads to it."""
    assert {tuple(r) for r in entry.queries()["coverage_ratio"](spark, far).select("qid", "covered").collect()} == {(0, 1), (50000, 1)}
    assert oracle.compare(spark, far, "coverage_ratio").endswith("equal")


def test_coverage_by_hits_equals_coverage_by_texts(spark):
    """Terms of chunks that are no candidates of the question do not count."""
    f = spark.createDataFrame([(1, [("azul", ["azul"]), ("rojo", ["rojo", "roja"])]), (2, [("verde", ["verd", "verde"]), ("nada", ["nada"])]), (3, [])], "qid long, forms array<struct<keyword:string,forms:array<string>>>")
    chunks = spark.createDataFrame([(1, "Casa ROJA", "es/a.md"), (2, "azul", "es/b.md"), (3, "x", "es/Verde.md"), (4, None, "es/nada.md")], "chunk_id long, text string, source string")
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (2, 1)], "qid long, chunk_id long")
    hits = spark.createDataFrame([(1, "roja"), (2, "azul"), (3, "verd"), (3, "verde"), (4, "nada")], "chunk_id long, term string")
    want = {tuple(r) for r in augment.coverage(f, pairs.join(chunks, "chunk_id")).collect()}
    assert {tuple(r) for r in augment.coverage_by_hits(f, pairs, hits).collect()} == want == {(1, 2, 1), (2, 2, 1)}


def test_prioritised_rounds_drop_twins(spark, monkeypatch):
    """Hundreds of near copies take no more rounds than chunks are selected."""
    made, real = [], rank.stored
    monkeypatch.setattr(rank, "stored", lambda df: made.append(df) or real(df))
    texts = [f"alpha beta gamma delta epsilon zeta eta{i % 3}" for i in range(300)] + ["other words here", "lone house", "red fox"]
    rows = [(1, i, text, 3, 0, 3, 1000.0 - i, i) for i, text in enumerate(texts)]
    c = spark.createDataFrame(rows, "qid long, chunk_id long, text string, m int, p int, n_keywords int, score double, rank int")
    assert [tuple(r) for r in rank.prioritised(c).orderBy("place").collect()] == [(1, 0, 0), (1, 1, 300), (1, 2, 301), (1, 3, 302)]
    assert len(made) <= 5


def test_numbered_over_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(rank, "ID_BITS", 2)
    ids = {1: [-9, -4, -1, 0, 3, 4, 17, 1 << 40], 2: [5], 3: list(range(-20, 20, 3))}
    rows = spark.createDataFrame([(q, i) for q, own in ids.items() for i in own], "qid long, chunk_id long")
    assert {tuple(r) for r in rank.numbered(rows).select("qid", "chunk_id", "rank").collect()} == {(q, i, n) for q, own in ids.items() for n, i in enumerate(sorted(own))}
