"""The pipeline's decisions stage by stage, and its queries against their SQL."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from mailspark.llm import mixing, queries, records
from mailspark.llm.tables import read
from tests.llm import samples
from tests.test_oracles import FOLDER, plain, sql  # noqa: F401

given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@given
def test_query_equals_sql(spark, sql, name):  # noqa: F811
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs


@given
def test_pipeline_on_the_given_tables(spark):
    texts = {r.doc_id: r for r in read(spark, FOLDER, "documents").collect()}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    kept = {r.doc_id for r in out}
    heads = {c for _, _, c in samples.components([(d, r.text) for d, r in texts.items()], 5, 80)}
    assert kept <= heads
    with open(records.VOCABULARY, "rb") as file:
        encoder = records._encoder(file.read())
    copies = Counter((r.doc_id, r.seq) for r in out)
    assert set(copies.values()) <= {1, 2}
    for r in out:
        if r.seq == 0:
            ids = np.frombuffer(r.tokens, "<u2").tolist()
            assert ids == [*encoder.encode_ordinary(texts[r.doc_id].text), records.END_OF_TEXT][:records.LENGTH]


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "What is the boiling point of water?"), (None, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    for rows in (samples.documents(9, 40), []):
        docs = samples.frame(spark, rows, parts=2)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert (last.count() > 0) == bool(rows)


def letters(rng, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def corpus() -> tuple[list[tuple], list[tuple], set[int]]:
    """Documents in four languages with near copies, junk with letters and a copied item; items; ids of the junk."""
    rng = random.Random(11)
    alphabets = {"en": "abcdeth", "de": "äöüßkz", "fr": "éèçlmn", "es": "ñíórsu"}
    words = {lang: [letters(rng, a, 2, 6) for _ in range(60)] for lang, a in alphabets.items()}
    items = [(k, " ".join(rng.choice(words["en"]) for _ in range(30))) for k in range(3)]
    rows = []
    for k in range(160):
        lang = sorted(words)[k % 4]
        text = [rng.choice(words[lang]) for _ in range(rng.choice([40, 90]))]
        if k % 16 == 1:
            text[20:20] = items[k % 3][1].split()
        rows.append((k, " ".join(text), lang, "abc"[k % 3], None, None, None))
    for k in range(0, 40, 5):  # near copies
        text = rows[k][1].split()
        text[len(text) // 2] = rng.choice(words["en"])
        rows.append((200 + k, " ".join(text), rows[k][2], "b", None, None, None))
    junk = [letters(rng, "abcdefghijklmnopqrstuvwxyz", 300, 300), " ".join(f"{rng.getrandbits(128):x}" for _ in range(9)),
            "漢字かな交じり文は日本語である。" * 6, "Это предложение на другом языке. " * 4, "wqxj vvgp " * 30, "123 456"]
    rows += [(300 + k, text, None, "a", None, None, None) for k, text in enumerate(junk)]
    return rows, items, {300 + k for k in range(len(junk))}


def mixed_rows(rows: list[tuple]) -> list[tuple]:
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in sorted({r[3] for r in rows})}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(size)}
    capped: set = set()
    while True:
        left = mixing.SHARE * sum(size.values()) - sum(mixing.MOST * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        target = {s: mixing.MOST * size[s] if s in capped else left * weight[s] / free for s in size}
        more = {s for s in size if target[s] > mixing.MOST * size[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in size:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (len(r[1].split()), r[0]))
        e, u = target[s] / size[s], int(hashlib.md5(f"mix:{s}".encode()).hexdigest()[:3], 16) / 4096
        for rank, r in enumerate(mine, 1):
            out += [r] * min(2, int(math.floor(rank * e + u) - math.floor((rank - 1) * e + u)))
    return out


def test_run_equals_a_plain_restatement(spark, tmp_path):
    rows, items, junk = corpus()
    folder = str(tmp_path)
    samples.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = read(spark, folder, "documents")
    readable = {r.doc_id for r in corpus_pipeline.readable(spark, docs, folder).collect()}
    assert {r[0] for r in rows} - readable == junk

    rows = [r for r in rows if r[0] not in junk]
    heads = {c for _, _, c in samples.components(rows, 5, 80)}
    grams = {tuple(t.split()[k:k + 12]) for _, t in items for k in range(len(t.split()) - 11)}
    clean = [r for r in rows if r[0] in heads
             and not any(tuple(r[1].split()[k:k + 12]) in grams for k in range(len(r[1].split())))]
    assert len(heads) < len(rows) and len(clean) < len(heads)
    bucket = {r.id: r.b for r in spark.range(400).selectExpr("id", "pmod(xxhash64(id), 256) as b").collect()}
    with open(records.VOCABULARY, "rb") as file:
        encoder = records._encoder(file.read())
    runs = []
    for r in sorted(mixed_rows(clean), key=lambda r: (bucket[r[0]], r[0])):
        ids = [*encoder.encode_ordinary(r[1]), records.END_OF_TEXT]
        runs += [(r[0], k // records.LENGTH, ids[k:k + records.LENGTH]) for k in range(0, len(ids), records.LENGTH)]
    slots = records.Permutation(len(runs), records.KEY)(np.arange(len(runs))).tolist()
    found = sorted((r.slot, r.doc_id, r.seq, np.frombuffer(r.tokens, "<u2").tolist()) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == sorted((slot, *run) for slot, run in zip(slots, runs))
