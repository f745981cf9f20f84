"""The prefix trie against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lodeleaf.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth int, pos int"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            body = (role or "", text or "")
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(body[0])}:{body[0]}{body[1]}".encode()).hexdigest(), len(body[1]), body))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(math.fmod(c, 100))  # as SQL has it, also below 0
        built[c] = tuple(convs.get(family, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    below = {k: [x for x in members if x[: len(k)] == k] for k in members}
    out = []
    for k, own in members.items():
        sub = below[k]
        inner = {x[:-1] for x in sub if x}
        ends = ",".join(str(c) for c in sorted(c for c in own if len(built[c]) == len(k)))
        out.append((
            min(own), len(k), min(members[k[:-1]]) if k else None, len(own), sum(len(x) == len(k) + 1 for x in sub), sum(x not in inner for x in sub),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


def run(spark, rows, tmp_path):
    full = spark.createDataFrame([(*x, 5, 6, 7) for x in rows], SCHEMA).repartition(3)
    full.write.parquet(f"{tmp_path}/conversations.parquet")
    out = trie.op12_prefix_rollup(spark, str(tmp_path))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r[n] for n in names) for r in out.collect())


def cases(n, longest, seed):
    """Conversations that share beginnings of any length, some gone on, some equal."""
    r = random.Random(seed)
    rows, texts = [], {}
    for c in [r.randrange(0, 5) * 100 + r.choice([0, 1, 2, 3, 50, r.randrange(100)]) for _ in range(n)]:
        if c in texts:
            continue
        old = r.choice([t for t in texts.values()] or [[]])
        own = old[: r.randrange(len(old) + 1)] + [(r.choice(["user", "assistant", None]), r.choice(["", "a", "bß𝄞", None, "long one"])) for _ in range(r.randrange(longest))]
        texts[c] = own
        rows += [(c, t * 2 if t else None, role, text) for t, (role, text) in enumerate(own)]
    return rows


@pytest.mark.parametrize("widths", [(8, 16, 32), (1, 2, 3)])
def test_shared_beginnings(spark, tmp_path, monkeypatch, widths):
    monkeypatch.setattr(trie, "WIDTHS", widths)
    rows = cases(40, 7, 2) + [(300 + i, t, "user", "same") for i in range(30) for t in range(12)]
    rows += [(None, 1, "user", "of no conversation"), (7, 1, "user", "tie"), (7, 1, "user", "eit"), (7, 1, "user", "tie"), (-250, 0, "user", "negative"), (-200, 0, "system", "x")]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_one_that_goes_on_under_a_smaller_end(spark, tmp_path, monkeypatch):
    """The node at the end of a block is named by a conversation that ends there."""
    monkeypatch.setattr(trie, "WIDTHS", (2,))
    rows = [(c, t, "user", f"{t}") for c, n in ((1, 8), (2, 11), (3, 11), (5, 30)) for t in range(n)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_only_turnless_conversations(spark, tmp_path):
    c = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 6 >= 1)
    assert run(spark, [(c, 1, "user", "gone")], tmp_path) == plain([(c, 1, "user", "gone")])


def test_jobs_do_not_grow_with_the_longest_conversation(spark, tmp_path, monkeypatch):
    """Each table written is some jobs, whose plans the driver holds."""
    made, real = [], trie.stored
    monkeypatch.setattr(trie, "stored", lambda df: made.append(df) or real(df))
    rows = [(c, t, "user", f"{min(t, 90)}") for c, n in ((1, 3), (2, 200), (3, 203)) for t in range(n)]
    assert run(spark, rows, tmp_path) == plain(rows)
    assert len(made) <= 9
