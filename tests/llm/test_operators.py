"""Every operator against a plain restatement, on rows with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mailspark.llm import (chat, graph, language, mixing, partenum, quality, records, repeats, scoring, tables, templates,
                           wordpiece, words)
from tests.llm import samples

ROWS = samples.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return samples.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return samples.frame(spark, [], parts=1)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# words

def test_words_and_keys():
    texts = pa.array(["A b  c\tA", None, "", " x ", "a b c a", "éa É b\x0bc", "   ", "w" * 3000])
    seen: dict = {}
    for lower in (False, True):
        for size in (1, 5, 1 << 20):
            for chunk in words.chunks(texts, lower, size=size):
                for r in range(chunk.rows):
                    text = texts[chunk.first + r].as_py()
                    want = (samples.lowered(text) if lower else (text or "").encode()).split()
                    part = slice(chunk.word_at[r], chunk.word_at[r + 1])
                    found = [bytes(chunk.data[a:b]) for a, b in zip(chunk.start[part], chunk.end[part])]
                    assert found == want
                    for word, key in zip(found, chunk.key[part]):
                        assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def test_lookup_finds_all_and_no_others():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = words.Lookup(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.find(keys[1::2]) == -1).all()


# benchmark decontamination

ITEMS = [(1, "John has 12 apples and gives 3 kg of them to Mary before lunch. How many apples does John have left?"),
         (2, "short one here"), (3, "What is the boiling point of water?"), (4, None), (5, "")]
HELD = [
    (1, "Noise. Peter has 15 apples and gives 7 kg of them to Susan before lunch. How many apples does Peter have left? tail"),
    (2, "Peter has 15 apples and gives 7 kg of them to Susan before lunch. How many apples does Oscar have left?"),
    (3, "john has 12 apples and gives 3 kg of them to mary before lunch. how many apples does john have left?"),
    (4, "JOHN HAS 12 APPLES AND GIVES 3 KG OF THEM TO MARY BEFORE LUNCH"), (5, None), (6, ""), (7, "one two three four. " * 50),
    (8, "Tell me, what is the boiling point of water?"), (None, "nothing of the kind"), (10, "x " * 100_000)]


@pytest.mark.parametrize("travel", [templates.TRAVEL, 0])
def test_leaks(spark, travel):
    docs, items = (spark.createDataFrame(r, s) for r, s in ((HELD, "doc_id long, text string"), (ITEMS, "item_id long, text string")))
    found = templates.leaks(docs, items, travel=travel)
    assert got(found, "doc_id", "item_id", "kind") == [
        (1, 1, "reparameterised"), (3, 1, "exact"), (4, 1, "exact"), (8, 3, "exact")]
    kept = templates.without_leaks(docs, items, travel=travel)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 6, 7, 10]
    assert templates.leaks(docs, items.where("false")).isEmpty() and templates.leaks(docs.where("false"), items).isEmpty()


def test_leaks_hold_every_copied_passage(spark):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(20)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(80))) for k in range(60)]
    planted = {k: rng.randrange(20) for k in range(0, 60, 3)}
    docs = [(k, f"{t[:100]} {items[planted[k]][1]} {t[100:]}" if k in planted else t) for k, t in docs]
    found = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found, "doc_id", "item_id") == sorted(planted.items(), key=repr)


def held(spark, item: str, *texts: str) -> list[str]:
    """The kinds of leak of the item in each text, - where there is none; the same when all windows are joined."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = []
    for travel in (templates.TRAVEL, 0):
        found = dict(got(templates.leaks(docs, items, travel=travel), "doc_id", "kind"))
        out.append([found.get(k, "-")[0] for k in range(len(texts))])
    assert out[0] == out[1]
    return out[0]


def test_leaks_whose_slots_disagree(spark):
    one_name = ITEMS[0][1].replace("does John", "does Oscar")
    assert held(spark, ITEMS[0][1], one_name, HELD[1][1]) == ["e", "-"]
    start = "The tall man went home very late that day. The small dog ran after him all the way there."
    assert held(spark, start, start.replace("The small", "A small").replace("The tall", "One tall")) == ["r"]
    counted = "Ann has 2 apples and buys 2 more at the shop. How many apples does she have now?"
    assert held(spark, counted, counted.replace("2 more", "3 more").replace("Ann", "Eve"),
                counted.replace("2 apples", "7 apples").replace("2 more", "5 more")) == ["r", "r"]
    long = "John went with Mary to the old town where they met some good friends of Mary and then had a very long talk about what John had seen."
    assert held(spark, long, long.replace("friends of Mary", "friends of Zoe").replace("John", "Tim")) == ["r"]


def test_leaks_with_values_of_other_token_counts(spark):
    item = "Yesterday Mary bought 25 pens and 3 kg of rice for Tom. How much did Mary pay?"
    assert held(spark, item, item.replace("Mary", "Mary Ann").replace("25", "twenty five").replace("3 kg", "3kg"),
                item.replace("Mary", "Jo").replace("25", "one hundred thirty-two").replace("3 kg", "7").replace("Tom", "Al B Cole"),
                item.replace("bought", "sold").replace("rice", "corn").replace("pay", "get")) == ["r", "r", "-"]


def test_leaks_of_short_and_dense_items(spark):
    assert held(spark, "What is 7 times 8?", "So, what is 7 times 8? Think.", "What is 7 times 9?") == ["e", "-"]
    assert held(spark, "Name it", "You name it", "Name him") == ["e", "-"]
    dense = "If Tom has 3 apples, Ann has 5 pears, Bob has 7 plums, Cid has 9 figs, who has most?"
    other = dense.replace("Tom", "Al").replace("Ann", "Bea").replace("Bob", "Cy").replace("Cid", "Di").translate(str.maketrans("3579", "2468"))
    assert held(spark, dense, other, other.replace("has", "had")) == ["r", "-"]
    values = "Add 1, 2, 3, 4, 5, 6, 7, 8, 9 and then take away 4, 3, 2, 1 from it all"
    assert held(spark, values, values.translate(str.maketrans("123456789", "987654321"))) == ["r"]
    assert held(spark, "水の沸点は何度ですか。海の上と山の上で違いますか", "問題：水の沸点は何度ですか。海の上と山の上で違いますか？答え",
                "問題：水の融点は何度だろうか") == ["e", "-"]
    assert held(spark, "首都はどこ", "日本の首都はどこですか", "首都はここ") == ["e", "-"]


# training records

def test_permutation_is_one():
    for n in (0, 1, 2, 3, 5, 17, 1000, 4097):
        for key in (1, 99):
            assert sorted(records.Permutation(n, key)(np.arange(n))) == list(range(n))


def test_records_round_trip(spark, docs, tmp_path):
    placed = records.in_training_order(docs, length=64, shard=50).collect()
    assert sorted(r.slot for r in placed) == list(range(len(placed)))
    again = records.in_training_order(docs.repartition(7), length=64, shard=50)
    assert got(again, "slot", "doc_id", "seq", "tokens") == sorted(((r.slot, r.doc_id, r.seq, r.tokens) for r in placed), key=repr)
    with open(records.VOCABULARY, "rb") as file:
        encoder = records._encoder(file.read())
    texts = Counter(tuple(encoder.encode_ordinary(r[1])) for r in ROWS if r[1])
    runs = defaultdict(list)
    for r in placed:
        runs[r.doc_id].append(r)
    single = [d for d, n in Counter(r[0] for r in ROWS if r[1]).items() if n == 1]
    for doc_id in single:
        ids = np.concatenate([np.frombuffer(r.tokens, "<u2") for r in sorted(runs[doc_id], key=lambda r: r.seq)])
        assert ids[-1] == records.END_OF_TEXT and tuple(ids[:-1].tolist()) in texts
    path = str(tmp_path / "shards")
    records.write_shards(again, path, 64)
    back = {r.slot: r.ids for r in records.read_shards(spark, path, 60, 64, 50).collect()}
    assert sorted(back) == list(range(60, len(placed)))
    for r in placed:
        if r.slot >= 60:
            assert back[r.slot] == (np.frombuffer(r.tokens, "<u2").tolist() + [records.END_OF_TEXT] * 64)[:64]


def test_shards_are_whole_however_the_records_come(spark, docs, tmp_path):
    want = got(records.in_training_order(docs, length=64, shard=50), "slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "tokens")
    path = str(tmp_path / "written")
    out = records.written(docs, path, length=64, shard=50)
    assert got(out, "slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "tokens") == want
    for r in out.collect():  # the record lies where the row says
        file, = (tmp_path / "written" / f"shard={r.shard}").glob("part-*")
        record = file.read_bytes()[r.byte_offset:r.byte_offset + records.stride(64)]
        assert len(record) == records.stride(64) and record.startswith(r.tokens) and record.endswith(b"\n")
    path = str(tmp_path / "dealt")
    rows = spark.createDataFrame(out.collect(), out.schema).repartition(7)
    records.write_shards(rows, path, 64)
    back = {r.slot: r.ids for r in records.read_shards(spark, path, 0, 64, 50).collect()}
    assert sorted(back) == [r[0] for r in sorted(want)]
    assert all(back[r[0]][:r[5]] == np.frombuffer(r[6], "<u2").tolist() for r in want)
    rows.where("shard = 0").selectExpr("cast(rpad(tokens, 128, X'50C4') as string) v").write.mode("append").text(f"{path}/shard=0")
    with pytest.raises(ValueError):
        records.read_shards(spark, path, 0, 64, 50)


def test_shards_in_portions(spark, docs, tmp_path, monkeypatch):
    """Portion by portion the same shards come out as at once; a portion's runs go as its shards are there."""
    names = ("slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "tokens")
    want = got(records.in_training_order(docs, length=64, shard=50), *names)
    monkeypatch.setattr(records, "PORTION_SHARDS", 2)
    monkeypatch.setattr(records, "PORTIONS", 3)
    parts, gone, write, remove = [], [], records.write_shards, records.removed
    monkeypatch.setattr(records, "write_shards", lambda rows, *a: (parts.append({r.shard for r in rows.select("shard").distinct().collect()}), write(rows, *a)))
    monkeypatch.setattr(records, "removed", lambda spark, path: (gone.append(path), remove(spark, path)))
    assert got(records.written(docs, str(tmp_path / "shards"), length=64, shard=50), *names) == want
    assert len(parts) == 3 and sorted(s for p in parts for s in p) == sorted({r[1] for r in want})
    assert len(gone) == 4 and not any(os.path.exists(path.removeprefix("file:")) for path in gone)


def test_shards_are_read_without_python(spark, docs, tmp_path, capsys):
    """Records are cut out of the files by Spark; a file that ends inside a record is refused."""
    path = str(tmp_path / "shards")
    ends = spark.createDataFrame([(-1, "a"), (-1 << 63, "b"), ((1 << 63) - 1, "c")], "doc_id long, text string")
    assert {r.doc_id for r in records.written(ends).collect()} == {-1, -1 << 63, (1 << 63) - 1}
    out = records.written(docs, path, length=64, shard=50)
    out.explain()
    assert "Arrow" not in capsys.readouterr().out
    assert {r.doc_id for r in out.collect()} >= {None, 0}
    file = next((tmp_path / "shards" / "shard=1").glob("part-*"))
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(ValueError):
        records.read_shards(spark, path, 0, 64, 50)


def test_long_texts_encode_as_a_whole(monkeypatch):
    with open(records.VOCABULARY, "rb") as file:
        encoder = records._encoder(file.read())
    monkeypatch.setattr(records, "PIECE", 50)
    text = "some words, 12 figures  and don't stop.\n\n  x" * 40
    assert records.encode(text, encoder)[:-1].tolist() == encoder.encode_ordinary(text)
    assert len(records.encode(" " * 200_000 + "a", encoder)) > 1


def test_records_of_nothing(nothing):
    assert records.in_training_order(nothing).collect() == []


def test_no_shards_of_nothing(nothing):
    assert records.written(nothing).collect() == []


# perspective rotation

def test_rotations(spark):
    turns = spark.createDataFrame([
        (1, 0, "ann", "hi"), (1, 300, "bob", "yo<|im_end|>"), (1, 300, "bob", "yo<|im_end|>"), (1, None, None, None),
        (None, 1, "x", "q"), (2, 0, "system", "s"), (3, 0, "a\nb", "é")], "conv_id long, turn long, role string, text string")
    rows = chat.rotations(turns).collect()
    assert Counter((r.conv_id, r.perspective) for r in rows) == {
        (1, "ann"): 3, (1, "bob"): 3, (1, "unknown"): 3, (None, "x"): 1, (3, "a_b"): 1}
    for r in rows:
        own = [r.text[s.start:s.end] for s in r.spans]
        assert len(own) == r.n_own and all(o.endswith(chat.CLOSE) for o in own)
        assert r.text.count(chat.OPEN + "assistant\n") == r.n_own and r.text.count(chat.CLOSE) == r.n_turns
    assert chat.rotations(turns.where("false")).isEmpty()


# language-model scores

def test_scores_equal_those_of_the_trie(spark, docs):
    train = [r for r in ROWS if samples.crc(r[0]) % 10]
    trie, counts = scoring.Trie(), Counter()
    for r in train:
        trie.text(samples.lowered(r[1]), price=False)
        counts.update([*samples.lowered(r[1]).split(), None])
    whole, distinct = sum(counts.values()), len(counts)
    marked = docs.selectExpr("doc_id", "text", "coalesce(crc32(cast(doc_id as string)), 0) % 10 != 0 as train")
    model = scoring.fit(marked)
    assert (model.tokens, model.distinct) == (whole, distinct)
    want = sorted(((r[0], n, sum(t in counts for t in ts), round(sum(
        math.log10((counts[t] + 0.1) / (whole + 0.1 * (distinct + 1))) for t in ts), 4), round(trie.text(samples.lowered(r[1]), learn=False), 4))
        for r in ROWS for ts in [[*samples.lowered(r[1]).split(), None]] for n in [len(ts)]), key=repr)
    for frequent in (scoring.FREQUENT, 40):
        rows = scoring.score(marked, model, frequent=frequent).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in rows), key=repr) == want


def test_probabilities_of_all_symbols_add_up():
    trie = scoring.Trie(2)
    trie.text(b"abracadabra")
    for past in (b"ab", b"zz", b"ra"):
        assert math.isclose(sum(10 ** trie.price(past, s) for s in range(256) if s != scoring.PAD), 1)


def test_adaptive_scores_and_empty_models(spark, docs, nothing):
    rows = dict(got(scoring.adaptive(docs.where("n_chars < 100 OR text IS NULL")), "doc_id", "adaptive_score"))
    assert all(v < 0 for v in rows.values())
    assert scoring.score(nothing, scoring.fit(nothing.selectExpr("doc_id", "text", "true as train"))).isEmpty()
    model = scoring.fit(docs.selectExpr("doc_id", "text", "false as train"))
    first = scoring.score(docs.where("text = ''"), model).first()
    assert (first.n_tokens, first.n_known) == (1, 0) and math.isclose(first.score, -math.log10(scoring.SYMBOLS))


# mixing

def test_mix_meets_targets(spark, docs):
    taken = mixing.sample(docs, mixing.word_count(docs["text"])).collect()
    assert len(taken) == len(ROWS) and {r._copies for r in taken} <= {0, 1, 2}
    by_source = defaultdict(list)
    for r in taken:
        assert r._size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        by_source[r.source].append(r)
    for rows in by_source.values():
        mixed = sum(r._size * r._copies for r in rows)
        assert abs(mixed - rows[0]._target) <= 2 * max(r._size for r in rows)
    assert math.isclose(sum(rows[0]._target for rows in by_source.values()), 1.5 * sum(r._size for r in taken))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r._copies for r in taken)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).isEmpty()


# n-gram Jaccard join

@pytest.mark.parametrize("n, percent, few, large", [(3, 90, 8, 1024), (5, 80, 3, 6), (2, 60, 8, 1024)])
def test_components_of_similar_sets(spark, docs, monkeypatch, n, percent, few, large):
    monkeypatch.setattr(partenum, "FEW", few)
    monkeypatch.setattr(partenum, "LARGE", large)
    found = partenum.near_duplicates(docs, n, percent)
    assert got(found, "doc_id", "n_shingles", "component_id") == samples.components(ROWS, n, percent)


@pytest.mark.parametrize("percent, few, many", [(60, 11, 18), (40, 8, 20), (25, 10, 40)])
def test_links_over_several_bands(spark, percent, few, many):
    rows = [(k, " ".join(f"w{i}" for i in range(n)), None, None, None, None, None) for k, n in enumerate((few, many))]
    found = partenum.near_duplicates(samples.frame(spark, rows), 1, percent)
    assert got(found, "doc_id", "component_id") == [(0, 0), (1, 0)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_texts_that_only_share_a_passage_are_not_compared(spark, n, percent):
    """A passage makes some parts equal, a link needs more of them; a near copy has them."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([word() for _ in range(200)] + passage + [word() for _ in range(200)]), None, None, None, None, None) for k in range(60)]
    rows.append((100, f"{rows[7][1]} end", None, None, None, None, None))
    found = partenum.signed_sets(samples.frame(spark, rows), n, percent)
    f = {r.doc_id: r.f for r in found.collect()}
    pairs = {(r.p, r.x) for r in partenum._first_pairs(found).collect()}
    assert pairs == {(min(f[7], f[100]), max(f[7], f[100]))}


def test_comparisons_follow_the_number_of_sets(spark, monkeypatch):
    """Near copies of a text that is not there itself, and texts that share a passage and a line: few comparisons for
    each set, in few rounds, and the same components as all pairs give."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    base, passage, line = ([word() for _ in range(n)] for n in (100, 50, 12))
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(100), rng.choice([1, 1, 1, 2])):
            copy[at] = word()
        texts.append(copy)
    texts += [[word() for _ in range(38)] + passage + line for _ in range(150)]
    rows = [(k, " ".join(text), None, None, None, None, None) for k, text in enumerate(texts)]
    made, compared = [], partenum._compared

    def counting(pairs, sets, percent):
        made.append(pairs.count())
        assert len(made) < 8 and sum(made) < 12 * len(rows), made
        return compared(pairs, sets, percent)

    monkeypatch.setattr(partenum, "LARGE", 64)
    monkeypatch.setattr(partenum, "_compared", counting)
    found = partenum.near_duplicates(samples.frame(spark, rows), 5, 80)
    assert got(found, "doc_id", "n_shingles", "component_id") == samples.components(rows, 5, 80)


def test_stored_tables_leave_no_shuffle_files(spark):
    left = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, setting = left(), spark.conf.get(tables.CLEANUP)
    table = tables.stored(spark.range(1000).repartition(5, "id"), "dealt")
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and spark.conf.get(tables.CLEANUP) == setting
    assert table.count() == 1000  # counting shuffles as well


def test_one_of_each_group_stays(docs, nothing):
    kept = partenum.one_of_each(docs)
    heads = {c for _, _, c in samples.components(ROWS, 5, 80) if c is not None}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == heads | {None}
    assert partenum.one_of_each(nothing).isEmpty()


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(40)] + [(None, 3), (5, 5)]
    import itertools
    group = {v: v for e in edges for v in e if None not in e}
    for _ in itertools.takewhile(lambda _: True, range(300)):
        for a, b in edges:
            if a is not None and a != b:
                group[a] = group[b] = min(group[a], group[b])
    real = {v for a, b in edges if a is not None and a != b for v in (a, b)}
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert got(found, "node", "root") == sorted(((v, group[v]) for v in real), key=repr)


# repeated passages

@pytest.mark.parametrize("window", [1, 2, 5, 13, 50])
def test_repeated_windows_go(docs, window):
    first: dict = {}
    for r in ROWS:
        ws = (r[1] or "").encode().split()
        for k in range(len(ws) - window + 1) if r[0] is not None else ():
            part = tuple(ws[k:k + window])
            first[part] = min(first.get(part, r[0]), r[0])
    want = []
    for r in ROWS:
        ws = (r[1] or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1) if r[0] is not None else ():
            if first[tuple(ws[k:k + window])] < r[0]:
                gone[k:k + window] = [True] * window
        want.append((r[0], len(ws), sum(gone), hashlib.md5(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()))
    found = repeats.dedupe(docs, window).selectExpr("doc_id", "n_words", "n_removed", "md5(kept) m")
    assert got(found, "doc_id", "n_words", "n_removed", "m") == sorted(want, key=repr)


def test_no_repeats_in_nothing(nothing):
    assert repeats.dedupe(nothing).isEmpty()


# quality rules

def test_statistics(docs):
    want = []
    for r in ROWS:
        text = r[1] or ""
        ws = [w for w in re.split(r"[ \t-\r]+", text) if w]
        lines = [line for line in text.split("\n") if re.search(r"[^ \t-\r]", line)]
        want.append((r[0], len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                     samples.repeated(ws), len(lines)))
    assert got(quality.statistics(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "n_lines") == sorted(want, key=repr)


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join(f"w{rng.randrange(500)}" + ("#" if bad and rng.random() < 0.5 else "") for _ in range(80))
    rows = [(k, text(k % 4 == 0)) for k in range(400)]
    labels = [(k, int(k % 4 > 0)) for k in range(0, 400, 2)] + [(None, 1), (3, None)]
    judged, rules = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"),
                                  spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules
    assert {r.doc_id for r in judged.collect() if not r.kept} == set(range(0, 400, 4))


def test_no_labels_no_rules(docs, nothing):
    judged, rules = quality.judge(docs, nothing.selectExpr("doc_id", "cast(n as int) as quality"))
    assert rules == [] and all(r.kept != r.base_failed for r in judged.collect())
    assert quality.judge(nothing, nothing.selectExpr("doc_id", "1 as quality"))[0].isEmpty()
    assert quality.learn({"a": np.zeros(5)}, np.ones(5, bool)) == [] and quality.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_pruning_and_order():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] > 0.5)) | (x["a"] < 0.1)
    rules = quality.learn(x, bad)
    covered = np.any([quality._covered(r, x, 3000) for r in rules], axis=0)
    assert len(rules) >= 2 and (covered == bad).mean() > 0.98


# language

def test_languages_of_held_out_rows(docs):
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 5 != 0"))
    rows = language.predict(docs, model).collect()
    truth = {r[0]: r[2] for r in ROWS}
    for r in rows:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id)
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(text) > 40 and r.doc_id is not None and truth[r.doc_id] and text.count(truth[r.doc_id]) > 0.9 * len(text.split()):
            assert r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1
    kept = language.readable(docs, model, 0.25)
    assert kept.columns == docs.columns and len({r.doc_id for r in kept.collect()} & {120, 121, 122, 123}) == 0


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    name = lambda k: f"{chr(97 + k % 17)}{chr(97 + k // 17)}"
    text = lambda k: " ".join(name(k) * rng.randint(1, 2) for _ in range(12))
    rows = [(k, text(k % 270), name(k % 270)) for k in range(270 * 8)] + [(9990 + k, "ŵŷẁ ŵŷ ẁŷ " * 4, "rare") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, most=300, dimensions=1 << 12)
    assert model.languages == sorted({r[2] for r in rows})
    assert language.sample(docs, 300).count() == min(len(rows), language.EACH * 271)
    assert {r.lang_pred for r in language.predict(docs.where("lang = 'rare'"), model, dimensions=1 << 12).collect()} == {"rare"}


def test_no_labels_no_language(docs, nothing):
    assert language.fit(nothing) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_weights_are_sparse_and_temperature_fits():
    rng = np.random.default_rng(0)
    rows = [(np.array([c, 2 + rng.integers(50)]), np.array([1.0, 0.3]), c) for c in rng.integers(0, 2, 400)]
    weights = language.follow_the_leader(rows, 60, 2)
    assert (weights[0] * weights[1] <= 0).all() and (weights == 0).sum() > 20
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.calibrate(logits * 3, labels) - 3) < 0.3


# token counts

def test_matcher_is_greedy():
    rng = random.Random(1)

    def greedy(word, pieces):
        n = at = 0
        while at < len(word):
            stop = next((k for k in range(len(word), at, -1) if word[at:k] in pieces), None)
            if stop is None:
                return -1
            n, at = n + 1, stop
        return n

    for _ in range(200):
        pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        matcher = wordpiece.Matcher(sorted(pieces))
        for _ in range(40):
            word = "▁" + "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert matcher.pieces(word) == greedy(word, pieces)


def test_token_counts(docs, nothing, monkeypatch):
    pieces = ["▁", "▁en", "▁long", "a", "b", "c", "d", "e", "t", "h", "en", "th"]
    matcher = wordpiece.Matcher(pieces)
    want = []
    for r in ROWS:
        sizes = [matcher.pieces("▁" + w) for w in re.split(r"[ \t-\r]+", r[1] or "") if w]
        want.append((r[0], len(sizes), sum(s if s >= 0 else 1 for s in sizes), sum(s < 0 for s in sizes)))
    assert got(wordpiece.token_counts(docs, pieces), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=repr)
    assert wordpiece.token_counts(nothing, pieces).isEmpty()
