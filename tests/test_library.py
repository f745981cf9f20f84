"""Operators on small tables, and the queries with SQL on the smallest data."""

import random
import time

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeleaf.operators import catalog, context, evaluate, near_pairs, rank, sync
from lodeleaf.sources.chunking import split_text
from lodeleaf.sources.html import page_text
from lodeleaf.sources.store import ChunkStore

SMALL = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, name).endswith("equal")


def test_entry(spark):
    rows = entry.entry(spark)
    assert {"qid", "context", "answer", "sources", "found"} <= set(rows.columns)
    found = rows.collect()
    assert found and all(r["context"] or r["greeting"] or not r["found"] for r in found)


def test_strength_and_score(spark):
    case = lambda m, p, n: spark.range(1).select(rank.is_strong(F.lit(m), F.lit(p), F.lit(n)).alias("v")).first()["v"]
    assert [case(2, 0, 3), case(3, 0, 3), case(1, 1, 3), case(0, 1, 3), case(3, 0, 5), case(0, 0, 0)] == [False, True, True, False, True, True]
    score = lambda p: spark.range(1).select(rank.score(F.lit(2), F.lit(p), F.lit(1.0), F.lit(2.0), F.lit(0), F.lit(3)).alias("v")).first()["v"]
    assert [score(1), score(0)] == [10497, 3497]


def test_prioritised_drops_near_duplicates(spark):
    rows = [(1, i, t, 3, 0, 3, float(s), i) for i, (t, s) in enumerate([("uno dos tres cuatro", 9), ("uno dos tres cinco", 8), ("uno dos tres cuatro nueve", 7), ("seis siete ocho", 6)])]
    c = spark.createDataFrame(rows, "qid long, chunk_id long, text string, m int, p int, n_keywords int, score double, rank int")
    assert [r["chunk_id"] for r in rank.prioritised(c).orderBy("place").collect()] == [0, 1, 3]  # 3 of 5 tokens is no duplicate, 4 of 5 is


def test_sync_plan(spark):
    table = lambda rows: spark.createDataFrame(rows, "source string, source_hash string")
    disk, index = table([("a", "h1"), ("b", "h2x"), ("c", "h3")]), table([("a", "h1"), ("b", "h2"), ("d", "h4")])
    steps = sync.plan(disk, index, spark.createDataFrame([("e",)], "source string"))
    assert {(r["source"], r["state"]) for r in steps.collect()} == {("c", "nuevo"), ("b", "modificado"), ("d", "eliminado"), ("e", "oculto")}
    new = disk.join(steps.filter("state in ('nuevo', 'modificado')").select("source"), "source", "left_semi")
    after = sync.applied(index, steps, new)
    assert sync.plan(disk, after, steps.select("source").limit(0)).count() == 0


def test_conversation(spark):
    t = spark.createDataFrame([(1, 1, "AI", "hola"), (1, 2, "user", " q ")], "conv_id int, turn int, role string, text string")
    assert context.conversation_block(t, F.lit("q")).first()["block"] == "ASSISTANT: hola"


def test_catalog(spark):
    c = spark.createDataFrame([(1, "x/a.md", "A", 1), (2, "x/a.md", "B", 0), (3, "y/b.md", "C", 0)], "chunk_id int, source string, text string, chunk_index int").withColumn("source_hash", F.lit("h"))
    assert {(r["source"], r["content"]) for r in catalog.details(c).collect()} == {("x/a.md", "B\n\nA"), ("y/b.md", "C")}
    assert sorted((r["source"], r["part"], r["content"]) for r in catalog.details(c, most=1).collect()) == [("x/a.md", 0, "B"), ("x/a.md", 1, "A"), ("y/b.md", 0, "C")]
    assert [r["path"] for r in catalog.folders(c).orderBy("path").collect()] == ["x", "y"]
    assert catalog.documents(c, text="c").count() == 1


def test_best_source(spark):
    c = spark.createDataFrame([(1, "a", 0, 1, 0), (1, "b", 1, 1, 1), (1, None, 2, 0, 0)], "qid int, source string, rank int, m int, p int")
    assert evaluate.best_sources(c).first()["source"] == "b"


def test_near_pairs_against_all_pairs(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    sets = {}
    for r in docs.orderBy("chunk_id").collect():
        sets.setdefault(frozenset(re.findall(r"\w{3,}", r["text"].lower())), r["chunk_id"])
    items = [(i, s) for s, i in sets.items() if s]
    want = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(items) for b, t in items[:k] if len(s & t) / len(s | t) > 0.6}
    assert {(r["a"], r["b"]) for r in near_pairs.similar_sets(docs).collect()} == want


def test_splitter():
    """Pieces are at most as long as asked, cover the text in order, and overlap by at most as much as asked."""
    text = "\n\n".join(f"parte {i} " + "palabra " * (i * 7 % 60) for i in range(40))
    parts = split_text(text, ("\n\n", "\n", " ", ""), 300, 60)
    at, end = 0, 0
    for p in parts:
        at = text.index(p, max(0, end - 60))
        assert len(p) <= 300 and not text[end:at].strip()
        assert end - at <= 60
        end = at + len(p)
    assert not text[end:].strip() and len(parts) > 5
    assert split_text("x" * 4000, ("\n\n", " ", ""), 1500, 300)[0] == "x" * 1500
    assert split_text("", ("\n", ""), 10, 2) == []


def test_html():
    text = page_text("<title>T</title><script>x()</script><p>uno</p><table><tr><th>A<th>B</th></tr><tr><td>1</td><td>2</td></tr></table><img src=a width=20><img src=b>")
    assert text.startswith("T") and "x()" not in text and text.count("[IMAGEN") == 1
    start, middle, end = text.index("[BLOQUE DELIMITADO 1 INICIO]"), text.index("A | B"), text.index("[BLOQUE DELIMITADO 1 FIN]")
    assert start < middle < text.index("1 | 2") < end < text.index("[IMAGEN") and "uno" in text


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), parts=4)
    rows = lambda *x: spark.createDataFrame([*x], "source string, chunk_index int, text string")
    store.append(rows(*((f"s{i}", 0, "x") for i in range(20))))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    store.replace(rows().select("source"), rows(("s3", 0, "new"), ("s3", 1, "newer")))
    assert {(r["source"], r["text"]) for r in store.read().collect()} == {(f"s{i}", "x") for i in range(20) if i != 3} | {("s3", "new"), ("s3", "newer")}
    assert sum(p.exists() for p in files) == len(files) - 1  # only one folder was written anew
    assert store.delete("s3") == 2 and store.read().count() == 19
    store.replace(store.read().select("source"))
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.delete("zzz")


def test_store_is_bucketed(spark, tmp_path):
    """Lookups read the folders of their sources; joins and groups by source move no chunk."""
    store = ChunkStore(spark, str(tmp_path / "store"), parts=8)
    rows = spark.createDataFrame([(f"s{i % 50}", i // 50, f"text {i}") for i in range(300)] + [(None, 0, "of no source")], "source string, chunk_index int, text string")
    store.append(rows)
    store.replace(store.read().select("source").limit(0), spark.createDataFrame([("s3", 0, "new", 7)], "source string, chunk_index int, text string, more int"))
    every = store.read()
    assert every.columns == ["source", "chunk_index", "text", "more"] and every.count() == 301 - 6 + 1
    assert ChunkStore(spark, str(tmp_path / "store"), parts=8).read().filter("more = 7").count() == 1
    some = spark.createDataFrame([("s3",), ("s7",)], "source string")
    found = store.lookup(some)
    files = lambda df: [f for f in df.inputFiles() if "/store/part=" in f]
    assert found.count() == 7 and len(files(found)) <= 2 < len(files(every))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (catalog.details(every.withColumn("chunk_id", F.col("chunk_index"))), every.groupBy("source").count())]
        assert not any("Exchange" in p for p in plans)
        for kind in ("inner", "left_anti", "full_outer"):
            plan = every.join(some, "source", kind)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1, kind
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_path_index_is_kept_up(spark, tmp_path):
    """After any number of plans, also repeated ones, it equals an index built anew."""
    from lodeleaf.operators import augment
    from lodeleaf.operators.path_index import PathIndex

    r, index, there = random.Random(3), PathIndex(spark, str(tmp_path / "index"), parts=4), set()
    names = [f"{a}/{b}{c}-x{i % 7}.md" for i, (a, b, c) in enumerate((a, b, c) for a in ("Manual", "guias") for b in ("Alta", "Baja") for c in ("Cliente", "Factura", "ñandú"))] + ["a/b.c"]
    for _ in range(4):
        now = set(r.sample(names, 6))
        steps = [(s, "nuevo") for s in now - there] + [(s, "eliminado") for s in there - now] + [(s, "modificado") for s in there & now]
        plan = spark.createDataFrame(steps, "source string, state string")
        index.update(plan)
        index.update(plan)
        there = now
        anew = augment.token_index(spark.createDataFrame([(s,) for s in there], "source string"))
        assert sorted(index.read().collect()) == sorted(anew.collect())
        assert sorted(index.numbers().collect()) == sorted(anew.groupBy("token").count().collect())
    before = sorted(index.numbers().collect())
    index.recount()
    assert sorted(index.numbers().collect()) == before


def test_synchronise(spark, tmp_path):
    """New, changed, hidden and vanished files."""
    from lodeleaf.sources.chunking import chunked
    from lodeleaf.streaming.sync import synchronise, watch

    root = tmp_path / "docs"
    root.mkdir()
    store = ChunkStore(spark, str(tmp_path / "store"), parts=4)
    read = lambda files: chunked(files.select("source", "source_hash", F.decode("content", "UTF-8").alias("text")), "md")
    texts = lambda: sorted(r["text"] for r in store.read().collect())
    for name, text in (("a", "hola mundo"), ("b", "fijo"), ("c", "va")):
        (root / f"{name}.md").write_text(text)
    assert {r["state"] for r in synchronise(spark, str(root), store, read).collect()} == {"nuevo"}
    assert texts() == ["fijo", "hola mundo", "va"]
    (root / "a.md").write_text("otro texto")
    (root / "c.md").unlink()
    synchronise(spark, str(root), store, read)
    assert texts() == ["fijo", "otro texto"]
    assert synchronise(spark, str(root), store, read).isEmpty()
    (root / "b.md.hidden").write_text("")
    running = watch(spark, str(root), store, read, str(tmp_path / "check"), "1 second")
    for _ in range(60):
        if texts() == ["otro texto"]:
            break
        time.sleep(1)
    running.stop()
    assert texts() == ["otro texto"]


def test_oracle_queries_give_rows(spark, sf):
    """Equal hashes of nothing show nothing."""
    empty = [n for n in ("path_token_match", "source_augment", "legacy_source_augment", "batch_evaluation", "priority_search", "compound_search", "literal_search", "chosen_sources") if entry.queries()[n](spark, f"{sf}/../sf0.01").isEmpty()]
    assert not empty


def test_answers_without_information_are_searched_again(spark):
    """The second search takes keywords in their order; its answer stands only if it has information."""
    from lodeleaf.plans.retrieval import retrieve

    words = ["alfaqz", "bravohy", "charlixw", "deltamnop", "echoqrstuv", "foxtrotvwxy", "golfnnnnnnnn", "hotelmmmmmmmmm"]
    texts = ["corta alfaqz bravohy", *(" ".join([*words[4:], *(f"relleno{i}{j}" for j in range(9))]) for i in range(5))]
    chunks = spark.createDataFrame([(i, f"d/{i}.md", f"h{i}", x) for i, x in enumerate(texts)], "chunk_id long, source string, source_hash string, text string")
    vectors = spark.createDataFrame([(i, [0.0, 1.0] if i == 0 else [1.0, i / 10]) for i in range(6)], "chunk_id long, vec array<double>")
    asked = spark.createDataFrame([(1, " ".join(["corta", *words]), [1.0, 0.0], [("user", "antes")])], "qid long, question string, qvec array<double>, conversation array<struct<role:string,text:string>>")
    said = lambda prompt: F.when(F.regexp_extract(prompt, r"(?s)Contexto:\n(.*?)\n\nPregunta", 1).contains("corta") & prompt.contains("USER: antes"), "respuesta con corta").otherwise("No se encuentra información")
    out = retrieve(asked, chunks, vectors, generator=said).first()
    assert out["found"] and out["answer"] == "respuesta con corta" and out["keywords"].startswith("corta")
    out = retrieve(asked, chunks, vectors, generator=lambda prompt: F.lit("No se encuentra información")).first()
    assert not out["found"]


def test_trace_and_observed_counts(spark, sf):
    """What a run observes equals what its rows say; a question without text is refused."""
    from pyspark.sql import Observation

    from lodeleaf.plans import retrieval
    from lodeleaf.plans import tables as t

    asked = t.question_vectors(spark, sf)
    more = asked.limit(1).select(F.lit(-1).cast("long").alias("qid"), F.lit("  ").alias("question"), "qvec")
    seen = Observation("retrieval")
    out = retrieval.retrieve(asked.unionByName(more), t.chunks(spark, sf), t.vectors(spark, sf), t.CONFIG, trace=True, seen=seen).collect()
    assert seen.get["questions"] == len(out) and seen.get["found"] == sum(r["found"] for r in out)
    assert all(seen.get[k] == sum(k in r["searches"] for r in out) for k in ("first", "order", "literal", "answer"))
    (blank,) = [r for r in out if r["qid"] == -1]
    assert blank["answer"] is None and not blank["found"] and blank["searches"] == [] and blank["candidates"] == []
    for r in out:
        ranks = [c["rank"] for c in r["candidates"] if c["phase"] == "vector"]
        assert len(ranks) <= 20 and len(ranks) == len(set(ranks)) and (not r["context"] or r["candidates"])
    assert any(r["candidates"] for r in out)


def test_batch_results(spark, tmp_path):
    """Strong candidates of the best source only; questions without candidates stay."""
    asked = spark.createDataFrame([(1, "uno"), (2, "dos")], "qid long, question string")
    rows = [(1, 10, "a", "alfa\nbeta", 0, 2, 1, 2, "vector"), (1, 11, "b", "gamma", 1, 1, 0, 2, "vector"), (1, 12, "a", "delta", 2, 2, 1, 2, "path")]
    c = spark.createDataFrame(rows, "qid long, chunk_id long, source string, text string, rank int, m int, p int, n_keywords int, phase string")
    out = evaluate.batch_results(asked, c, lambda prompt: F.lit("sí"))
    first, second = out.orderBy("qid").collect()
    assert (first["sources"], first["documents_used"], first["appended_by_source"], first["fragments"], first["context"]) == (["a"], 2, 1, ["alfa beta", "delta"], "alfa\nbeta\n\ndelta")
    assert (second["sources"], second["documents_used"], second["fragments"], second["context"]) == ([], 0, [], "")
    evaluate.write_results(out, str(tmp_path / "out"))
    assert {r["question"] for r in spark.read.json(str(tmp_path / "out/jsonl")).collect()} == {"uno", "dos"}
    text = evaluate.report(out).orderBy("qid").first()["markdown"]
    assert text == "## uno\n\n**Respuesta:**\n\nsí\n\n**Fuentes:** a\n\n**Fragmentos utilizados:** 2\n\n**Fragmentos añadidos por ruta:** 1\n\n"
