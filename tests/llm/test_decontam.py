"""Benchmark overlap against plain windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from fixtures import LOWER, awkward

from lodeleaf.llm import decontam

PARTS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, spans string, wid string"


def item_words(text):
    return PARTS.findall((text or "").translate(LOWER))


def plain(docs, items):
    """doc_id, n_words, n_hit, ids of every document."""
    wins = set()
    for i, t in items:
        w = item_words(t)
        wins |= {(tuple(w[s : s + 10]), i) for s in range(max(1, len(w) - 9)) if w}
    sought: dict[tuple, set] = {}
    for w, i in wins:
        sought.setdefault(w, set()).add(i)
    sizes = {len(w) for w in sought}
    out = []
    for d, t in docs:
        w, hit, ids = item_words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (own := sought.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    ids |= {i for i in own if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def run(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontam.op13_benchmark_overlap(spark, str(tmp_path))
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())


def cases():
    base = awkward()[0][1].split(" ")
    items = [(1, " ".join(base[20:45])), (2, "One, TWO"), (2, "tie"), (3, None), (4, ""), (5, " ,.- "), (None, " ".join(base[60:75])), (10, " ".join(base[30:42])), (9, "w77777 " + " ".join(base[:9])), (11, "one two"), (12, "ß ☃ 𝄞 näïve ß")]
    return [(i, t, 7, "x", "y") for i, t in items]


@pytest.mark.parametrize("bound", [None, 24 * 5])
def test_awkward_texts(spark, docs, tmp_path, monkeypatch, bound):
    """Also with tokens that take several passes and relations too large for a broadcast."""
    if bound:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(decontam, "small", lambda df: df)
    got = run(spark, docs, spark.createDataFrame(cases(), ITEMS), tmp_path)
    assert got == plain([(r[0], r[1]) for r in awkward()], [(r[0], r[1]) for r in cases()])


def test_frequent_words_and_repeats(spark, tmp_path):
    """Few different words, copies, items inside items: windows overlap, meet often and are shared."""
    r = random.Random(5)
    line = lambda n, v: " ".join(f"v{r.randrange(v)}" for _ in range(n))
    items = [(i, line(r.choice([1, 2, 3, 9, 10, 11, 40]), r.choice([1, 2, 30]))) for i in range(30)] + [(99, "v0 " * 25)]
    docs = [(i, " ".join([line(20, 2), r.choice(items)[1], line(30, 30), r.choice(items)[1]])) for i in range(60)]
    docs += [(100 + i, docs[3][1]) for i in range(40)] + [(300, "v0 " * 400)]
    got = run(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 1, "", "") for x in items], ITEMS), tmp_path)
    assert got == plain(docs, items)


def test_without_items(spark, docs, tmp_path):
    got = run(spark, docs, spark.createDataFrame([], ITEMS), tmp_path)
    assert got == plain([(r[0], r[1]) for r in awkward()], [])


def test_spans(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[5:17])), (2, " ".join(words[15:30])), (3, " ".join(words[40:50]))], "item_id long, text string")
    (row,) = decontam.overlaps(docs, items).collect()
    assert [tuple(s) for s in row["spans"]] == [(5, 30), (40, 50)] and row["item_ids"] == ["1", "2", "3"]
