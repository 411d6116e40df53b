"""Small tables with the awkward rows, and plain restatements of what the operators have to give."""

from __future__ import annotations

import random
import zlib
from collections import Counter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"


def lowered(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def documents(seed: int = 7, n: int = 120) -> list[tuple]:
    """Near and exact copies, shared passages, nulls in any column, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = {lang: [f"{lang}{''.join(rng.choice(letters) for _ in range(rng.randint(2, 6)))}" for _ in range(300)]
             for lang, letters in (("en", "abcdeth"), ("de", "äöüßkz"))}
    bases = [[rng.choice(words[lang]) for _ in range(rng.choice([3, 14, 60, 150]))] for lang in ("en", "de") * 4]
    shared = [rng.choice(words["en"]) for _ in range(20)]
    rows = []
    for k in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words["en"][:40])
        if rng.random() < 0.2:
            text += shared
        lang = "en" if text[0].startswith("en") else "de"
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(text), lang, rng.choice(["a", "b", "B", "é", None]), len(text), "x", 1))
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, "x", 1), (n + 2, " \n\t", "en", "a", 3, "x", 1),
             (n + 3, "123 456!", "de", "b", 8, "x", 1), (None, rows[0][1], "en", "a", 1, "x", 1), rows[3], rows[3],
             (n + 4, "long " * 40_000 + "tail", "en", "c", 200_004, "x", 1), (n + 5, "One", None, "c", 3, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=DOCUMENTS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def shingles(text: str | None, n: int) -> frozenset:
    words = lowered(text).split()
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def components(rows, n: int, percent: int) -> list[tuple]:
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0


def repeated(words: list[bytes], n: int = 3) -> int:
    windows = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    gone = [False] * len(words)
    for k in range(len(words) - n + 1):
        if windows[tuple(words[k:k + n])] > 1:
            gone[k:k + n] = [True] * n
    return sum(gone)
