"""That ranking holds a bounded number of candidates of a question at once."""

import random

from pyspark.sql import functions as F

from lodeleaf.operators import rank


def test_prioritised_many_candidates(spark, monkeypatch):
    """Equal to a plain greedy pass, with no list of more rows than a round has."""
    r, real = random.Random(8), F.collect_list
    monkeypatch.setattr(rank.F, "collect_list", lambda c: F.when(F.size(real(c)) <= rank.ROUND, real(c)).otherwise(F.raise_error(F.lit("unbounded"))))
    vocabulary = ["casa", "perro", "arbol", "monte", "nube", "fuego", "piedra"]
    rows = []
    for q, n_keywords in ((1, 3), (2, 3), (3, 0), (4, 3)):
        for i in range(3 if q == 4 else 150):
            text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 7)))
            rows.append((q, i, text, 1 if q == 2 and i > 1 else r.choice([1, 3]), 0, n_keywords, float(r.randrange(20)), i))
    want = set()
    for q in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == q]
        strong = {x[1] for x in own if x[5] == 0 or x[3] >= 3}
        own = [x for x in own if x[5] == 0 or x[1] in strong or len(strong) < 5]
        own.sort(key=lambda x: (0, 0.0, x[7], x[1]) if x[5] == 0 else (x[1] not in strong, -x[6], x[7], x[1]))
        done = []
        for x in own:
            t = set(x[2].split()) if x[5] else set()
            if len(done) < 5 and not any(t and d and len(t & d) / len(t | d) > 0.6 for _, d in done):
                done.append((x[1], t))
        want |= {(q, place, i) for place, (i, _) in enumerate(done)}
    c = spark.createDataFrame(rows, "qid long, chunk_id long, text string, m int, p int, n_keywords int, score double, rank int")
    out = [tuple(x) for x in rank.prioritised(c).select("qid", "place", "chunk_id").collect()]
    assert len(out) == len(set(out)) and set(out) == want
