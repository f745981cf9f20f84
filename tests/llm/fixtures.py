"""Small tables with the awkward cases, and plain Python versions of what operators compute."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, block int, line string"


def long_text(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i) % 5003}" for i in range(n))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    base = long_text(1, 120)
    texts = [
        (1, base, "a"), (2, base, "b"), (3, base.replace("w", "W", 3), "a"), (4, long_text(2, 90), None), (5, None, "a"), (6, "", "b"), (7, " \n\t ", "b"), (8, "one two", "c"), (9, "ONE two", "c"),
        (10, long_text(3, 30_000), "a"), (None, long_text(4, 60), "a"), (None, None, None), (12, "tie", "a"), (12, "tie", "a"), (13, base + " more words at the end", "d"), (14, "näïve ß ☃ 𝄞\n" * 30, "d"),
    ]
    return [(i, t, "en", s, len(t or ""), 3, "big", 9, "own") for i, t, s in texts]


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text: str | None) -> frozenset:
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest id that each id reaches over all pairs of similar texts."""
    sets: dict[int, list[frozenset]] = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    label = {i: i for i in sets}
    ids = sorted(sets)
    alike = lambda a, b: any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(a, b)]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
