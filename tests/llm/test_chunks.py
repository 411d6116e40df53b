"""What is made of a text at a time is bounded by its bytes and not by a batch; results do not depend on it."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from mailspark.llm import language, partenum


def texts(n: int = 400) -> pa.Array:
    rng = random.Random(6)
    some = ["", None, " ", "É", "ÀÇ×Ø Þß", "Привет МИР", "漢字かな", "😀 a😀B", "Ω Σα", "ª©"]
    some += ["".join(chr(rng.choice([rng.randrange(1, 0x500), rng.randrange(0x3000, 0xD000), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(rng.randrange(40)))
             for _ in range(n)]
    return pa.array(some + [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(n)])


def folded(text: str | None) -> str:
    fold = lambda c: chr(ord(c) + 32) if c != "×" and any(a <= ord(c) <= b for a, b in ((65, 90), (0xC0, 0xDE), (0x391, 0x3A9), (0x410, 0x42F))) else c
    return "".join(map(fold, text or ""))


def test_code_points_are_those_of_python():
    column = texts()
    raw = [(t or "").encode() for t in column.to_pylist()]
    at = np.cumsum([0, *map(len, raw)])
    point, text_at = language._code_points(np.frombuffer(b"".join(raw), np.uint8), at)
    assert [point[a:b].tolist() for a, b in zip(text_at[:-1], text_at[1:])] == [[ord(c) for c in folded(t)] for t in column.to_pylist()]


def test_chunk_size_changes_nothing(monkeypatch):
    column, found = texts(), []
    for size in (1 << 8, 1 << 16, 1 << 20):
        monkeypatch.setattr(language, "CHUNK", size)
        parts = [(first + row, feature, count) for first, _, row, feature, count in language.term_counts(column)]
        found.append([np.concatenate(c).tolist() for c in zip(*parts)])
    assert found[0] == found[1] == found[2]


def test_counting_takes_the_memory_of_a_chunk():
    column = pa.array([" ".join(f"w{k}" for k in range(200))] * 4_000)
    next(iter(language.term_counts(column)))
    tracemalloc.start()
    for _ in language.term_counts(column):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and partenum.CHUNK <= 1 << 16
