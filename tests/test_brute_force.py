"""Set-based operators against plain step-by-step models on small random inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailspark.operators import candidates as cd, ingest as ig, review as rv, threads as th
from tests.conftest import rows

START = datetime(2026, 1, 1)

# --- threads --------------------------------------------------------------------------------------------------


THREAD = "id long, normalized_message_id string, in_reply_to string, references_ids array<string>, received_at timestamp"


def assigned(spark, messages, parts=3):
    """messages: (id, message id, in reply to, references, minute or None)."""
    data = [(i, mid, irt, refs, None if t is None else START + timedelta(minutes=t)) for i, mid, irt, refs, t in messages]
    df = spark.createDataFrame(data, THREAD).selectExpr(
        "*", "concat('subject ', id) as subject", "'a@x' as from_addr", "cast(null as string) as body_sha256",
        "cast(null as string) as auto_submitted", "true as is_canonical", "false as stale").repartition(parts)
    return th.assign_threads(df)


def keys_of(df):
    return {r["id"]: r["root_key"] for r in rows(df)}


@pytest.mark.parametrize("messages, want", [
    # a reply, and a message that only refers: the reference deepest in its thread leads
    ([(1, "a", None, [], 0), (2, "b", "a", [], 1), (3, "z", None, [], 2), (4, "c", None, ["z", "b"], 3)],
     {1: "a", 2: "a", 3: "z", 4: "a"}),
    # answers to a message that never came meet under its id; a later reference to it joins them
    ([(1, "d", "g", [], 0), (2, "e", "g", [], 1), (3, "i", None, ["g"], 2), (4, "h", None, ["unseen"], 3)],
     {1: "g", 2: "g", 3: "g", 4: "h"}),
    # no id: a key of its own; an answer that came before its question opens a thread, and the question joins it
    ([(1, None, None, [], 0), (2, "j", "k", [], 1), (3, "k", "j", [], 2)], {1: "sha256:row1", 2: "j", 3: "j"}),
    # references in a circle lead nowhere
    ([(1, "p", None, ["q"], 0), (2, "q", None, ["p"], 1)], {1: "p", 2: "q"}),
    # messages without a time come first
    ([(1, "l", "m", [], 5), (2, "m", None, [], None)], {1: "m", 2: "m"}),
])
def test_threads_worked_by_hand(spark, messages, want):
    assert keys_of(assigned(spark, messages)) == want


@pytest.mark.parametrize("seed", [2, 4])
def test_threads_keep_their_rules(spark, seed):
    rnd = random.Random(seed)
    ids = [f"m{i}@x" for i in range(40)]
    links = ids + [f"ghost{g}@y" for g in range(8)]
    messages = [(i, rnd.choice(ids) if rnd.random() < 0.85 else None, rnd.choice(links) if rnd.random() < 0.5 else None,
                 rnd.sample(links, rnd.randint(0, 4)) if rnd.random() < 0.6 else [],
                 rnd.randint(0, 50) if rnd.random() < 0.9 else None) for i in range(60)]
    made = assigned(spark, messages).cache()
    key = keys_of(made)
    place = lambda m: (m[4] is not None, m[4] or 0, m[0])
    holder = {}
    for m in sorted(messages, key=place):
        if m[1]:
            holder.setdefault(m[1], m)
    assert set(key) == {m[0] for m in messages}
    for m in messages:
        anchor = holder.get(m[2])
        if m[1] in key.values():
            assert key[m[0]] == m[1] or key[holder[m[1]][0]] != m[1] or place(m) <= place(holder[m[1]])
        elif m[2] and anchor is None:  # answers to what never came share its id
            assert key[m[0]] == m[2]
        elif anchor is not None and place(anchor) < place(m):  # an answer is where its older question is
            assert key[m[0]] == key[anchor[0]]
        elif not m[2] and not m[3]:
            assert key[m[0]] == (m[1] or f"sha256:row{m[0]}")
    # the order of rows does not matter
    rnd.shuffle(messages)
    assert keys_of(assigned(spark, messages, 1)) == key
    stats = th.thread_stats(made).first()
    assert stats["messages"] == 60 and stats["threads"] == len(set(key.values()))
    known = {m[1] for m in messages}
    assert stats["ghosts"] == len({k for k in key.values() if not k.startswith("sha256:") and k not in known})


# --- copies that arrive together ------------------------------------------------------------------------------


def test_copies_of_one_batch(spark):
    rnd = random.Random(7)
    batch = [("a", f"f{rnd.randint(0, 2)}", 1, i, f"h{rnd.randint(0, 25)}", f"m{rnd.randint(0, 25)}@x" if rnd.random() < 0.7 else None)
             for i in range(60)]
    stored = spark.createDataFrame([], "id long, account string, folder string, uid_validity long, uid long, body_sha256 string, "
                                       "normalized_message_id string, stale boolean, folder_moved boolean, is_canonical boolean")
    arrivals = spark.createDataFrame(batch, "account string, folder string, uid_validity long, uid long, body_sha256 string, "
                                            "normalized_message_id string").repartition(3)
    got = {r["uid"]: (r["action"], r["batch_of"]) for r in rows(ig.classify_arrivals(arrivals, stored))}
    kept, expected = [], {}
    for row in sorted(batch, key=lambda r: (r[0], r[1], r[3])):
        match = next((k for k in kept if k[4] == row[4] or (row[5] and k[5] == row[5])), None)
        expected[row[3]] = ("copy", match[3]) if match else ("new", None)
        if not match:
            kept.append(row)
    assert got == expected


# --- commands -------------------------------------------------------------------------------------------------


def test_commands_match_one_after_the_other(spark):
    rnd = random.Random(5)
    states = ["pending", "approved", "push_failed", "conflict", "externally_modified", "rejected", "missing", "pushed"]
    events = {i: {"status": rnd.choice(states), "title": f"t{i}", "attempts": 2} for i in range(12)}
    commands = [(s, 0, rnd.randint(0, 13), rnd.choice(["approve", "reject", "ignore", "edit", "adopt", "retry"]),
                 rnd.choice([None, f"new{s}"])) for s in range(80)]
    df = spark.createDataFrame([(i, e["status"], e["title"], 2) for i, e in events.items()],
                               "id long, status string, title string, push_attempts int")
    df = df.selectExpr("*", "cast(null as timestamp) start_ts", "true needs_attention", "cast(null as timestamp) updated_at",
                       "false manual_edited", "cast(null as map<string,string>) field_provenance", "'s' snapshot_hash",
                       "'r' remote_norm_hash", "'p' snapshot_payload", "cast(null as string) managed_state",
                       "cast(null as timestamp) last_checked_at")
    asked = spark.createDataFrame(commands, "seq long, pos int, id long, action string, title string").withColumn(
        "start_ts", F.lit(None).cast("timestamp"))
    after, outcomes = rv.transition(df, asked, F.lit(START))
    expected = {}
    for seq, _, i, action, title in commands:
        e = events.get(i)
        target = {"approve": "approved", "reject": "rejected", "ignore": "ignored"}.get(action, "approved")
        ok = e is not None and {
            "edit": title is not None, "adopt": e["status"] in ("conflict", "externally_modified"),
            "retry": e["status"] in ("push_failed", "uncertain", "missing")}.get(action, e["status"] == "pending")
        expected[seq] = "not_found" if e is None else "changed" if ok else "skipped"
        if ok:
            e["status"] = target
            e["title"] = title if action == "edit" else e["title"]
            e["attempts"] = 0 if action == "retry" else e["attempts"]
    assert {r["seq"]: r["result"] for r in rows(outcomes)} == expected
    assert {r["id"]: (r["status"], r["title"], r["push_attempts"]) for r in rows(after)} == {
        i: (e["status"], e["title"], e["attempts"]) for i, e in events.items()}


def test_bad_ids_are_an_error(spark):
    df = spark.createDataFrame([(1, "1,x")], "seq long, event_ids string")
    with pytest.raises(Exception, match="cannot read event ids"):
        rv.expand_ids(df).collect()
    good = spark.createDataFrame([(1, "3-1, 2,7")], "seq long, event_ids string")
    assert [r["id"] for r in rows(rv.expand_ids(good), "pos")] == [1, 2, 3, 7]


# --- hints and siblings ---------------------------------------------------------------------------------------


def _tokens(title):
    return {w for w in title.split() if len(w) >= 3}


def test_probable_duplicates_find_every_first_match(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    items = [(f"d{rnd.randint(0, 2)}", i, " ".join(rnd.choices(words, k=rnd.randint(1, 7)))) for i in range(90)]
    # a third of one block are copies of a single title
    items += [("d0", 100 + i, "alpha beta gamma") for i in range(40)]
    df = spark.createDataFrame(items, "block string, ord long, title string").repartition(4)
    got = {r["ord"]: (r["duplicate_of"], r["similarity"]) for r in rows(rv.probable_duplicates(
        df, "block", "ord", "title"))}
    expected = {}
    for block, i, title in items:
        for other, j, earlier in sorted(items, key=lambda x: x[1]):
            a, b = _tokens(title), _tokens(earlier)
            if other == block and j < i and len(a & b) / min(len(a), len(b)) >= 0.8:
                expected[i] = (j, round(len(a & b) / min(len(a), len(b)), 2))
                break
    assert got == expected


def test_sibling_counts(spark):
    rnd = random.Random(3)
    events = [(i, rnd.randint(0, 3), START + timedelta(minutes=15 * rnd.randint(0, 96 * 2)), rnd.random() < 0.2) for i in range(80)]
    df = spark.createDataFrame(events, "id long, message_id long, start_ts timestamp, all_day boolean")
    got = {r["id"]: (r["conflicts"], r["siblings"]) for r in rows(rv.sibling_counts(df))}

    def local(ts):
        return (ts + timedelta(hours=8)).date()

    for i, m, ts, _ in events:
        peers = [(abs((t - ts).total_seconds()), a) for j, n, t, a in events if j != i and n == m and local(t) == local(ts)]
        far = sum(1 for gap, all_day in peers if gap > 3600 and not all_day)
        assert got[i] == (far, len(peers) - far)


# --- merging sources ------------------------------------------------------------------------------------------


def test_slots_merge_like_a_fold(spark):
    rnd = random.Random(9)
    rank = {"ics": 3, "rules": 2, "llm": 1}
    base = []
    for message in range(25):
        members = sorted((rnd.choice(list(rank)) for _ in range(rnd.randint(1, 6))), key=lambda s: -rank[s])
        for i, source in enumerate(members):
            base.append({"message_id": message, "ord": i, "source": source, "title": rnd.choice(["A one", "B two", "a ONE", ""]),
                         "start": START + timedelta(minutes=30 * rnd.randint(0, 3)), "all_day": rnd.random() < 0.15,
                         "generic": rnd.random() < 0.4, "review": rnd.random() < 0.5, "evidence": f"e{i}", "fp": f"{message}.{i}"})
    schema = ("message_id long, ord int, title string, start_ts timestamp, end_ts timestamp, all_day boolean, source string, "
              "confidence double, fingerprint string, evidence string, requires_review boolean, review_reason string, "
              "title_from_subject boolean")
    df = spark.createDataFrame([(c["message_id"], c["ord"], c["title"], c["start"], None, c["all_day"], c["source"], 0.9, c["fp"],
                                 c["evidence"], c["review"], "why" if c["review"] else "", c["generic"]) for c in base], schema)
    got = {r["fingerprint"]: (r["title"], r["evidence"], r["requires_review"]) for r in rows(cd.dedupe_slots(df.repartition(4)))}
    expected = {}
    for message in range(25):
        mine = [dict(c) for c in base if c["message_id"] == message]
        timed = [c for c in mine if not c["all_day"]]
        if timed:
            for c in (c for c in mine if c["all_day"]):
                for t in timed:
                    t["evidence"] += f"；另有 {c['source']} 给出同日全天：{c['title']}"
            mine = timed
        best = {}
        for c in mine:
            slot = "all" if c["all_day"] else c["start"]
            if slot not in best:
                best[slot] = c
                continue
            kept = best[slot]
            if c["title"] and c["title"].lower() != kept["title"].lower():
                if kept["generic"] and not c["generic"]:
                    kept["title"] = c["title"]
                else:
                    kept["evidence"] += f"；另有 {c['source']} 给出：{c['title']}"
            kept["review"] = kept["review"] or c["review"]
        for c in best.values():
            expected[c["fp"]] = (c["title"], c["evidence"], c["review"])
    assert got == expected
