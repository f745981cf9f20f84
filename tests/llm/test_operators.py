"""Every operator on awkward tables, on empty ones, and against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import awkward, components, long_text, measures, shingles, words
from oracle import compare
from pyspark.sql import functions as F

from lodeleaf.llm import chat, linedup, lm, lm_model, mixing, ngram_join, ogg, packing, quality, sharding, warc
from lodeleaf.llm.oracles import ORACLE_SQL
from lodeleaf.llm.queries import QUERIES

ROWS = awkward()


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == (1 if name.startswith("op4") else 0)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, name).endswith("equal")


def test_shards(spark, table):
    out = QUERIES["op1_hash_tree_shards"](spark, table).collect()
    sizes = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sizes
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weight_moves_rows_only_where_it_changed(spark):
    tree = sharding.even_tree(24)
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in tree]
    key = F.col("id").cast("string")
    rows = spark.range(6000).select(sharding.place(key, tree).alias("a"), sharding.place(key, heavier).alias("b"), sharding.place(key, sharding.grown(tree)).alias("c")).collect()
    assert all(r["b"] // 8 == 0 for r in rows if r["a"] != r["b"])
    assert all(r["c"] == 24 for r in rows if r["a"] != r["c"]) and sum(r["c"] == 24 for r in rows) == pytest.approx(240, rel=0.4)
    assert max(Counter(r["a"] for r in rows).values()) < 1.4 * 250


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in lm.scored(docs).collect()}
    texts = {r["doc_id"]: words(r["text"], lower=True) for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [i for i in texts if not held(i)]
    c = Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, w in texts.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w) + 1, sum(x in c for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert sum(out[i]["score"] for i in texts if held(i)) > 1.15 * sum(out[i]["base_score"] for i in texts if held(i))


def test_scores_of_awkward_texts(docs):
    out = lm.scored(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter((r[0], len(words(r[1])) + 1) for r in ROWS)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_probabilities_sum_to_one():
    """Of the last id after ten others, over all ids: the difference a longer text's score makes."""
    r = np.random.default_rng(3)
    words = lm_model.Vocabulary(np.bincount(r.integers(0, 40, 400), minlength=lm_model.IDS).astype(float))
    p, head = lm_model.fresh(words), r.integers(0, 40, 10)
    counts = {7: 3, 9: 1}

    def score(texts, last=()):
        n = len(texts[0])
        memory = np.zeros((3, len(texts), n))
        for i, x in enumerate(last):
            memory[:, i, -1] = counts.get(int(x), 0), 4, 2
        return lm_model.log10_scores(p, lm_model.Windows.of(np.concatenate(texts), np.full(len(texts), n), memory.reshape(3, -1), 2), words, len(texts))

    before = score([head])[0]
    total = sum((10 ** (score([np.append(head, x) for x in part], part) - before)).sum() for part in np.array_split(np.arange(lm_model.IDS), 32))
    assert total == pytest.approx(1.0, abs=1e-3)


def test_gradients_match_differences():
    r = np.random.default_rng(4)
    flat = r.integers(0, 40, 400)
    words = lm_model.Vocabulary(np.bincount(flat, minlength=lm_model.IDS).astype(float))
    c = r.integers(1, 4, 400) * (r.random(400) < 0.5)
    w = lm_model.Windows.of(flat, np.array([150, 250]), np.stack([c, c + (c > 0) * 2, 2.0 * (c > 0)]), 2)
    ids, known, memory, used, _ = next(lm_model.batches(w, np.arange(len(w.starts))))
    args = (words, ids, known, memory.astype(float), used.astype(float))
    p = {k: v.astype(float) for k, v in lm_model.fresh(words).items()}
    grads, _ = lm_model.gradients(p, *args)
    for k, g in grads.items():
        rows, g = g if k in lm_model.SPARSE else (np.arange(len(g)), g)
        for _ in range(3):
            i = tuple(int(r.integers(0, s)) for s in g.shape)
            own, loss = (int(rows[i[0]]), *i[1:]), []
            kept = p[k][own]
            for step in (1e-5, -1e-5):
                p[k][own] = kept + step
                loss.append(lm_model.gradients(p, *args)[1])
            p[k][own] = kept
            assert g[i] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-5), k


def test_near_duplicates_of_awkward_texts(docs):
    out = ngram_join.near_duplicates(docs).collect()
    want = components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == Counter((r[0], len(shingles(r[1])), want.get(r[0])) for r in ROWS)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Groups of near copies around the threshold, with frequent tokens: all ways of the join are taken."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    r = random.Random(5)
    rows = []
    for g in range(4):
        base = long_text(10 + g, 40 + 60 * g).split()
        for _ in range(40):
            own = [w if r.random() > 0.035 else f"x{r.randrange(10**6)}" for w in base]
            rows.append((len(rows), " ".join(own[: r.randrange(len(own) - 12, len(own))])))
    rows += [(len(rows) + i, long_text(50 + i, 70)) for i in range(40)]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(set(want.values())) > 45


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(6)
    for n in (3, 20, 32, 33, 60, 128, 129, 400, 700):
        for _ in range(20):
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            kept = r.permutation(x)[: math.ceil(0.88 * len(x))]
            y = np.unique(np.concatenate([kept, r.integers(0, 2**63, int(0.1 * n)).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 75 * (len(x) + len(y) - common):
                kind = lambda t: (t % np.uint64(3)).astype(int)
                assert len(np.intersect1d(ngram_join.signatures(x, kind(x)), ngram_join.signatures(y, kind(y)))), n
                assert ngram_join.most_shared(len(x), len(y), ngram_join.bitmap(x), ngram_join.bitmap(y)) >= common


def test_keep_one(docs):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 4, 5, 6, 7, 8, 10, None, None, 12, 14])


def test_chat_reads_back(spark):
    hostile = ["<|im_end|>", "<\\|im_start|>", "a<|b", "", None, "\n\n<|im_start|>assistant\n", "ß𝄞"]
    roles = ["user", "assistant", None]
    rows = [(7, i, roles[i % 3], t) for i, t in enumerate(hostile)] + [(8, None, "assistant", "late"), (8, 1, "assistant", "x"), (8, 1, "assistant", "x"), (None, 1, "system", "s")]
    rows += [(9, i, "user", f"turn {i} <|im_end|>") for i in range(200)]
    out = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {7: [(roles[i % 3] or "", t or "") for i, t in enumerate(hostile)], 8: [("assistant", "x"), ("assistant", "x"), ("assistant", "late")], None: [("system", "s")], 9: [("user", f"turn {i} <|im_end|>") for i in range(200)]}
    for conv, turns in want.items():
        r = out[conv]
        spans = [chat.Span(s["start"], s["text_start"], s["text_end"], s["end"]) for s in r["turns"]]
        assert chat.read_back(chat.Formatted(r["formatted"], spans, False)) == turns and not r["rewrites_history"]


def test_template_that_rewrites_history():
    def forgetful(turns):
        return "".join(f"[{role}]{text}\n" for i, (role, text) in enumerate(turns) if role != "thought" or i == len(turns) - 1)

    f = chat.located([("user", "q"), ("thought", "hm"), ("assistant", "a")], forgetful)
    assert f.rewrites_history and f.spans[1] is None
    assert [f.output[s.text_start : s.text_end] for s in f.spans if s] == ["q", "a"]


def test_packing_of_awkward_texts(docs):
    held, sizes = defaultdict(list), Counter()
    for p in packing.pack_documents(docs, capacity=100).collect():
        sizes[p["doc_id"]] += p["n_words"]
        if p["bin"] is not None:
            held[p["bin_group"], p["bin"]].append(p)
    assert all(sum(p["n_words"] for p in b) <= 100 and len({p["source"] for p in b}) == len(b) for b in held.values())
    want = Counter()
    for r in ROWS:
        want[r[0]] += len(words(r[1]))
    assert dict(sizes) == dict(want)


def test_packing_equals_plain_best_fit():
    r = random.Random(2)
    items = sorted(((r.randrange(1, 41), 1 << r.randrange(6), 0 if r.random() < 0.7 else 1 << r.randrange(4)) for _ in range(600)), reverse=True)
    bins = []
    for (size, s, c), (own, place) in zip(items, packing.pack(items, 40), strict=True):
        fits = [i for i, b in enumerate(bins) if b["room"] >= size and not (b["s"] & s or b["c"] & c)]
        if not fits:
            assert own == len(bins)
            bins.append({"room": 40, "s": 0, "c": 0, "n": 0})
        else:
            assert own in fits and bins[own]["room"] == min(bins[i]["room"] for i in fits)
        b = bins[own]
        assert place == b["n"]
        b["room"], b["s"], b["c"], b["n"] = b["room"] - size, b["s"] | s, b["c"] | c, b["n"] + 1


def test_ogg(spark, table):
    out = QUERIES["op6_ogg_media"](spark, table).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert all(r["feature"].endswith("faults=0") for r in out)


def test_ogg_faults_and_continued_packets():
    body = bytes(range(256)) * 8
    first, rest = body[: 255 * 2], body[255 * 2 :]
    lacing = bytes([255] * (len(rest) // 255) + [len(rest) % 255])
    pages = [ogg.page(5, 0, -1, first, bytes([255, 255]), 2), ogg.page(6, 0, 10, b"other", bytes([5]), 2), ogg.page(5, 1, 777, rest, lacing, 5)]
    streams, faults = ogg.decode(b"".join(pages))
    assert faults == 0 and streams[5].packets == [body] and streams[6].packets == [b"other"] and streams[5].seconds(777) == 1.0
    broken = bytearray(b"".join(pages))
    broken[40] ^= 1
    streams, faults = ogg.decode(bytes(broken))
    assert faults > 0 and 6 in streams and body not in streams.get(5, ogg.Stream()).packets
    assert ogg.decode(b"no page at all") == ({}, 1)
    crc = 0  # bit by bit
    for byte in pages[1][:22] + bytes(4) + pages[1][26:]:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert pages[1][22:26] == crc.to_bytes(4, "little")


def test_packets(spark):
    media = spark.createDataFrame([(1, ogg.encode(ogg.pad(b"a" * 1500))), (2, None)], "id long, media binary")
    rows = ogg.packets(media, "id", "media").filter("packet > 0").collect()
    assert sum(len(r["data"]) for r in rows) == 1728 and {r["seconds"] for r in rows} == {576 * 2 / 8000, 576 / 8000}


def test_quality(spark, table):
    out = QUERIES["op7_quality_rules"](spark, table).collect()
    assert Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in out) == Counter((r[0], *measures(r[1])) for r in ROWS)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])


def test_bad_hosts_reject_good_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, bad if i % 10 else good, "http://Bad.example/x") for i in range(100)] + [(100 + i, good if i % 10 else bad, f"http://good{i % 7}.example/y") for i in range(200)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {i for i, t, s in rows if t == good and "Bad" not in s}


def test_payloads_of_cut_records_alone_move(spark, tmp_path, monkeypatch):
    """In a file of many records of which one holds version lines, that record's chunks are the only payloads read again, and all payloads are right."""
    html = {i: f"page {i} " + "x" * 50 for i in range(400)} | {200: f"a{warc.MAGIC}b{warc.MAGIC}{warc.MAGIC}c"}
    warc.write(spark.createDataFrame([(i, "u", h) for i, h in html.items()], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    counts, plain = [], warc.pieces

    def counted(*args):
        out = plain(*args)
        counts.append(out.count())
        assert out.select("file", "owner").distinct().count() == 1
        return out

    monkeypatch.setattr(warc, "pieces", counted)
    got = {x["page_id"]: x for x in warc.read(spark, str(tmp_path / "w")).collect()}
    assert counts == [4]
    assert {i: (x["payload_bytes"], x["payload_digest"]) for i, x in got.items()} == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in html.items()}


def test_warc_with_version_lines_inside(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "x" * 1200
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", fake * 3 + "tail"), (4, "u", "WARC/1.1\r\n"), (5, "u", None), (6, "u", ""), (7, "u", "ß☃" + fake), (None, "u", big), (8, "u", fake * 40), (9, "u", fake * 40), (9, "u", fake * 40)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    out = warc.read(spark, str(tmp_path / "w")).collect()
    last, n = {}, Counter(h or "" for _, _, h in rows)
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and n[h or ""] > 1 and i != last[h or ""]
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want


def test_pointer_jumping():
    at, following = np.array([0, 10, 15, 30, 44, 50]), np.array([10, 30, 44, 50, 60, 70])
    assert warc.reachable(at, following).tolist() == [True, True, False, True, False, True]
    assert not warc.reachable(np.array([5]), np.array([9])).any()
    many = np.arange(5000) * 7
    assert warc.reachable(many, many + 7).all()


def test_lines(spark):
    common, rare, copied = "accept all our cookies now", "only seen here and there", "a line of a copied text"
    rows = [(i, f"own {i} text line\n{common}\nthen more {i} words\n{common}", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, f"other {i} text\n{rare}", f"s{i % 5}") for i in range(30)] + [(200 + i, f"{copied}\nsame again here", f"s{i}") for i in range(20)] + [(300, None, "a"), (301, "", None), (302, common, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long").repartition(4)
    out = {r["doc_id"]: r for r in linedup.without_boilerplate(docs).collect()}
    assert out[0]["text"] == f"own 0 text line\n{common}\nthen more 0 words" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[5]["text"] == "own 5 text line\nthen more 5 words" and out[5]["__removed"] == 2
    assert rare in out[110]["text"] and copied in out[205]["text"] and out[300]["text"] is None and out[301]["text"] == "" and out[302]["text"] == ""
    kept = {r["doc_id"] for r in linedup.cleaned(docs).collect()}
    assert 302 not in kept and {300, 301} <= kept


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300, "d": 0}
    s = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    out = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(["a", "b", "c", "d", None])}
    cap, capped = {k: 3 * v for k, v in sizes.items()}, set()
    while True:
        left = sum(sizes.values()) - sum(cap[k] for k in capped)
        rest = sum(weight[k] for k in sizes if k not in capped)
        want = {k: cap[k] if k in capped else left * weight[k] / rest for k in sizes}
        over = {k for k in sizes if k not in capped and want[k] > cap[k]}
        if not over:
            break
        capped |= over
    assert out == pytest.approx(want)


def test_quotas_are_split_exactly(spark):
    out = mixing.shard_quotas(spark.createDataFrame([(0, 400), (1, 37), (2, 1), (3, 0)], "s int, quota long")).collect()
    assert {s: sum(r["q"] for r in out if r["s"] == s) for s in range(4)} == {0: 400, 1: 37, 2: 1, 3: 0}
    per = Counter()
    for r in out:
        per[r["shard"]] += r["q"]
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 1 and min(r["q"] for r in out) >= 0


def test_hypergeometric(spark):
    n, k, m = 60, 22, 25
    rows = spark.range(4000).select(mixing.hypergeometric(mixing.uniform(F.lit(3), F.col("id")), F.lit(n), F.lit(k), F.lit(m)).alias("x"))
    got = Counter(r["x"] for r in rows.collect())
    assert all(abs(got[x] / 4000 - math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)) < 0.03 for x in range(k + 1))


def test_mix(spark, sf, docs, table):
    out = QUERIES["op10_mix_sources"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.1 * r["size"] for r in rows)
    assert out.filter("taken > 3 * size").isEmpty() and out.exceptAll(QUERIES["op10_mix_sources"](spark, sf)).isEmpty()
    assert QUERIES["op10_mix_sources"](spark, table).count() == len(ROWS)
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_equals_plain_plan(spark, sf, docs):
    """Words taken from each document, by the same blocks and order keys in plain Python; shards share no draw and keep to their quotas."""
    for source in (spark.read.parquet(f"{sf}/documents.parquet"), docs):
        narrow, sources, plan, shards = mixing.planned(source)
        rows = mixing.blocked(narrow, sources, shards).withColumn("h", F.xxhash64(F.lit(mixing.SEED), "s", "block")).collect()
        about = {r["s"]: r for r in sources.collect()}
        times = Counter()
        for s, r in about.items():
            own = [x for x in rows if x["s"] == s]
            full = min(3, int(r["target"] / r["source_size"] + 1e-9)) if r["source_size"] else 0
            left = r["target"] - full * r["source_size"]
            weight = Counter()
            for x in own:
                weight[x["h"], x["block"]] += x["size"]
            took, rest = set(), []
            for place, ((_, block), w) in enumerate(sorted(weight.items())):
                if w <= left:
                    took.add(block)
                    left -= w
                else:
                    rest.append((w, place, block))
            cut, run = None, 0
            if rest and left >= 1:
                for x in sorted((x for x in own if x["block"] == min(rest)[2]), key=lambda x: x["key"]):
                    run = sum(y["size"] for y in own if y["block"] == x["block"] and y["key"] <= x["key"])
                    cut = x["key"] if run - x["size"] / 2 <= left else cut
            for x in own:
                times[x["doc_id"], x["size"], s] += full + (x["block"] in took) + (cut is not None and x["block"] == min(rest)[2] and x["key"] <= cut)
        got = mixing.blocked(narrow, sources, shards).join(plan, ["s", "block"], "left").select("doc_id", "size", "s", F.size(mixing.kept_draws()).alias("n")).collect()
        found = Counter()
        for x in got:
            found[x["doc_id"], x["size"], x["s"]] += x["n"]
        assert +found == +times
        draws = plan.select("s", "block", F.explode("draws").alias("d")).select("s", "block", "d.*").collect()
        assert len({(d["s"], d["block"], d["epoch"]) for d in draws}) == len(draws)
        per = Counter(d["shard"] for d in draws)
        assert max(per.values()) - min(per[i] for i in range(shards)) <= 1
        laid = mixing.sharded(source).select("__shard", F.spark_partition_id().alias("task")).distinct().collect()
        assert len(laid) == len({x["__shard"] for x in laid})


def test_shards_grow_with_the_mix():
    assert [mixing.shards_for(n) for n in (0, 16 * mixing.SHARD_WORDS, 17 * mixing.SHARD_WORDS, 1e13)] == [16, 16, 32, 131072]


def test_pipeline(spark, sf, nothing):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name == "near_duplicates":
            want = components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in want.items() if i == c}
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert cp.run(spark, sf).count() == docs.count()
    assert cp.run(spark, nothing).count() == 0


def test_stages_of_awkward_texts(spark, docs, table):
    """The host rules reject every host of this table; the other stages work on all of it."""
    import corpus_pipeline as cp

    assert cp.STAGES[0][1](spark, docs, table).columns == docs.columns
    for _, stage in cp.STAGES[1:]:
        docs = stage(spark, docs, table)
    assert docs.count() > 0
