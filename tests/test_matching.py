"""Matches told chunk by chunk: as by hits and joins, without moving a hit or a match."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeleaf.operators import augment, matching, rank
from lodeleaf.operators import terms as walk
from lodeleaf.plans import queries, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def asked(spark):
    """Features and chunks with words in texts and paths, core forms, synonyms, a code, empty and null texts."""
    words = ["alpha", "disco", "unidad", "src7", "clon", "ab-12", "único", "omega"]
    questions = spark.createDataFrame([(i, " ".join(words[i % 3 : i % 3 + 1 + i % 6])) for i in range(23)] + [(99, None), (98, "")], "qid long, question string")
    text = lambda i: None if i == 50 else "" if i == 51 else " ".join(w.upper() for j, w in enumerate(words) if i >> j & 1)
    chunks = spark.createDataFrame([(i * 37 % 211, text(i), f"en/src{i % 9}/Alpha{'Disco' * (i % 2)}-{i % 5}.md", "h") for i in range(211)], "chunk_id long, text string, source string, source_hash string")
    return retrieval.features(questions, queries.CONFIG, queries.SETTINGS).cache(), chunks.repartition(5).cache()


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


FOUND = ("qid", "chunk_id", "m", "p", "quality", "priority", "useful", "useful_chars")


@pytest.mark.parametrize("term_bytes", [1 << 22, 300])
def test_every_match_equals_matches_by_hits(spark, asked, monkeypatch, term_bytes):
    monkeypatch.setattr(walk, "TERM_BYTES", term_bytes)
    f, chunks = asked
    want = rows(retrieval.matches(f, retrieval.form_hits([f], chunks)), *FOUND)
    assert rows(retrieval.every_match(f, chunks), *FOUND) == want and len(want) > 1000
    pairs = spark.createDataFrame([(q, c) for q in range(23) for c in range(q, 211, 1 + q % 7)], "qid long, chunk_id long")
    assert rows(retrieval.every_match(f, chunks, pairs), *FOUND) == rows(retrieval.matches(f, retrieval.form_hits([f], chunks), pairs), *FOUND)


def test_chunk_matches_moves_nothing(spark, sf):
    assert "Exchange" not in plan(entry.queries()["chunk_matches"](spark, sf))


def test_strong_and_score_moves_no_match(spark, sf):
    """Texts are dealt out for their order, and counts; matches are given out where they are made."""
    assert "Exchange" not in plan(entry.queries()["strong_and_score"](spark, sf)).split("MapInArrow")[0]


def test_numbered_over_ranges_of_ids(spark, asked, monkeypatch):
    monkeypatch.setattr(matching, "RANGE_BITS", 4)
    f, chunks = asked
    want = rows(rank.numbered(retrieval.every_match(f, chunks)), *FOUND, "rank")
    assert rows(matching.numbered(retrieval.searchable_rows(chunks), f), *FOUND, "rank") == want and max(x[-1] for x in want) > 100


def test_covered_keywords_equal_coverage_by_hits(spark, asked):
    f, chunks = asked
    want = rows(augment.coverage_by_hits(f, retrieval.every_match(f, chunks), augment.covering(f, chunks)), "qid", "n_keywords", "covered")
    assert rows(augment.coverage_by_keywords(f, retrieval.covered_keywords(f, chunks)), "qid", "n_keywords", "covered") == want


def test_coverage_ratio_joins_no_match(spark, sf):
    assert plan(entry.queries()["coverage_ratio"](spark, sf)).count("Join") == 1


@pytest.mark.parametrize("held, term_bytes", [(1 << 20, 1 << 22), (3, 200)])
def test_sources_that_tokens_point_at(spark, monkeypatch, held, term_bytes):
    """One token stands in all paths; the sources of most tokens come first, then by name."""
    monkeypatch.setattr(augment, "HELD", held)
    monkeypatch.setattr(augment, "TERM_BYTES", term_bytes)
    index = [(f"t{t}", f"s{s:03}") for s in range(150) for t in range(12) if t == 0 or s * 7 % (t + 3) == 0]
    tokens = [(q, f"t{t}") for q in range(30) for t in range(14) if t == 0 or (q + t) % 4 == 0]
    want = []
    for q in range(30):
        own = {t for p, t in tokens if p == q}
        hits = {s: len([1 for t, x in index if x == s and t in own]) for s in {s for _, s in index}}
        want += [(q, s, hits[s]) for s in sorted(hits, key=lambda s: (-hits[s], s))[:5]]
    found = augment.pointed_at(spark.createDataFrame(tokens, "qid long, token string"), spark.createDataFrame(index, "token string, source string").repartition(3), 5)
    assert rows(found, "qid", "source", "hits") == sorted(want)


def test_priority_in_path_equals_priority_by_pairs(spark, asked):
    """Of sources with two chunks both are taken, of larger ones the best two; no pair of question and chunk is made before it matches."""
    f, chunks = asked
    want = rows(augment.by_priority(f, chunks, lambda pairs: retrieval.every_match(f, chunks, pairs), queries.no_candidates(chunks)), "qid", "chunk_id")
    found = augment.by_priority_in_path(f, chunks, lambda names, some: retrieval.called_matches(f, some, names))
    assert rows(found, "qid", "chunk_id") == want and len(want) > 50


def test_path_augmentation_with_candidates(spark, asked):
    """Sources of candidates count by their own hits, however many others hold as many."""
    f, chunks = asked
    some = spark.createDataFrame([(q, c) for q in range(23) for c in (q, q + 50, 200)], "qid long, chunk_id long")
    index = augment.token_index(chunks)
    hits = augment.matched_tokens(f, index).join(index, "token").groupBy("qid", "source").agg(F.count(F.lit(1)).alias("hits"))
    old = some.join(chunks, "chunk_id").select("qid", "source").distinct()
    first = {(r["qid"], r["source"]) for r in hits.join(old, ["qid", "source"]).collect()}
    found = augment.by_path(f, chunks, lambda pairs: retrieval.every_match(f, chunks, pairs), some, queries.SETTINGS).join(chunks, "chunk_id")
    assert {(r["qid"], r["source"]) for r in found.collect()} & first


@pytest.mark.parametrize("name", ["source_lists", "batch_evaluation"])
def test_keywords_are_extracted_once(spark, sf, name):
    """What is left to do when candidates are known does not extract questions' keywords again."""
    assert "levenshtein" not in plan(entry.queries()[name](spark, sf))
