"""Operators that settle in rounds or by blocks: greedy matching, noise components, re-read, one-scan statistics."""

from datetime import date
import inspect
import random

from pyspark.sql import functions as F

from mailspark.operators import clusters, evaluate, reconcile, reread, review, stats
from mailspark.plans.daily import Settings
from tests.conftest import rows


def test_first_come_equals_the_ordered_rule(spark):
    rng = random.Random(6)
    pairs = [(rng.choice("ab"), rng.randrange(40), rng.randrange(25)) for _ in range(200)] + [("chain", k + d, k) for k in range(12) for d in (0, 1)]
    pairs += pairs[:3]
    want, taken, used = [], set(), set()
    for name, c, e in sorted(pairs):
        if (name, c) not in taken and (name, e) not in used:
            taken.add((name, c))
            used.add((name, e))
            want.append((name, c, e))
    schema = "name string, cand_ord long, exp_ord long"
    found = evaluate.first_come(spark.createDataFrame(pairs, schema))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert evaluate.first_come(spark.createDataFrame([], schema)).isEmpty()


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(150)}", f"k{rng.randrange(130)}") for _ in range(170)]
    pairs += [(f"c{k:02}", f"link{k + d}") for k in range(40) for d in (0, 1)] + [(f"h{k}", "hot") for k in range(300)] + pairs[:5]
    parent: dict = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for node, key in pairs:
        parent[find(("key", key))] = find(node)
    least: dict = {}
    for node, _ in pairs:
        least[find(node)] = min(least.get(find(node), node), node)
    found = clusters.components(spark.createDataFrame(pairs, "node string, key string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted({(n, least[find(n)]) for n, _ in pairs})


def test_unsubscribe_targets(spark):
    links = {"https://www.Shop.example/Leave/?u=1&t=2": "shop.example/Leave", "http://user@shop.example:8080/a#x": "shop.example/a",
             "HTTPS://SHOP.example": "shop.example", "mailto:Off@X.example?subject=bye": "off@x.example", " mailto:a@b ": "a@b",
             "ftp://x/y": None, "": None, None: None}
    data = spark.createDataFrame([(k, v) for k, v in links.items()], "link string, want string")
    for r in data.select("link", "want", clusters.unsubscribe_target(F.col("link")).alias("got")).collect():
        assert r.got == r.want, r.link


def test_noise_components_of_awkward_rows(spark):
    schema = "from_addr string, list_id string, unsubscribe string, flags array<string>, received_at timestamp"
    mail = [("A@x.org", None, "https://l.org/u?1", [], None), ("b@y.org", "", "https://www.l.org/u/?2", ["\\Seen"], None),
            ("b@y.org", "News", None, [], None), ("c@z.org", "news", None, None, None), ("d@w.org", None, None, [], None),
            ("me@x.org", None, None, [], None), ("", "news", None, [], None), (None, None, None, [], None), ("e", None, None, [], None)]
    contacts = spark.createDataFrame([("ME@x.org", 2), ("c@z.org", 0), (None, 1)], "addr string, replied_count long")
    got = rows(clusters.noise_components(spark.createDataFrame(mail, schema), contacts), "cluster")
    assert [(r["cluster"], r["senders"], r["messages"], r["unread"], r["target"]) for r in got] == [
        ("a@x.org", 3, 4, 3, "l.org/u"), ("d@w.org", 1, 1, 1, None), ("e", 1, 1, 1, None)]
    assert clusters.noise_components(spark.createDataFrame([], schema), contacts).isEmpty()


MAIL = "account string, folder string, uid_validity long, uid long, received_day date"


def test_reread_fills_holes_below_the_cursor(spark, tmp_path):
    raw = [("a", f, 1, u, date(2026, 1, 1 + u // 3000)) for f in ("in", "out") for u in range(1, 9001)] + [("a", "in", 1, None, date(2026, 1, 3))]
    holes = {5, 4095, 4096, 7000, 8192, 8193, 9000}
    df = spark.createDataFrame(raw, MAIL)
    df.write.partitionBy("received_day").parquet(str(tmp_path / "raw"))
    stored = df.where(~F.coalesce(F.col("uid"), F.lit(5)).isin(*holes))
    due = spark.createDataFrame([("a", "in", 1), ("a", "in", 1)], "account string, folder string, uid_validity long")
    lost = reread.lost_messages(spark.read.parquet(str(tmp_path / "raw")), stored.unionByName(stored), due, F.lit(date(2026, 1, 2)))
    assert [(r["folder"], r["uid"]) for r in rows(lost, "uid")] == [("in", u) for u in sorted(holes) if u >= 3000]
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "received_day" in plan.split("PartitionFilters")[1][:120]
    spans = reread.known_spans(stored.where("folder = 'in'"))
    assert sum(len(r.spans) for r in spans.collect()) == 5  # 1-4, 6-4094; 4097-6999, 7001-8191; 8194-8999
    nothing = reread.lost_messages(spark.read.parquet(str(tmp_path / "raw")), df, due, F.lit(date(2026, 1, 1)))
    assert nothing.isEmpty()


def test_sections_in_one_scan(spark):
    table = spark.createDataFrame([("x", "p", True), ("x", None, False), (None, "p", None)], "a string, b string, ok boolean")
    every = F.count(F.lit(1))
    made = lambda df: stats.sections(df, {"by_a": ("a", None), "by_b": ("b", "unknown")}, all={"total": every, "ok": F.count_if("ok")})
    assert sorted(map(tuple, made(table).collect()), key=repr) == sorted([
        ("all", "ok", 1), ("all", "total", 3), ("by_a", None, 1), ("by_a", "x", 2), ("by_b", "p", 2), ("by_b", "unknown", 1)], key=repr)
    assert sorted(map(tuple, made(table.where("false")).collect())) == [("all", "ok", 0), ("all", "total", 0)]


def test_snapshot_scans_each_table_once(spark, tmp_path):
    tables = {"messages": "extract_status string, has_ics boolean, has_unsubscribe boolean", "processed": "status string",
              "events": "status string, source string, needs_attention boolean", "pushes": "state string",
              "threads": "link_strength string", "senders": "addr string", "runs": "ok boolean"}
    for name, kind in tables.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / name))
    found = stats.snapshot(**{name: spark.read.parquet(str(tmp_path / name)) for name in tables})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(tables)
    assert {r["n"] for r in rows(found)} == {0}


def test_work_lists_have_no_default_limit():
    for f in (reconcile.push_plan, review.review_items, review.review_page, review.due_pushes, stats.mailbox):
        assert inspect.signature(f).parameters["limit"].default is None
    assert Settings.push_limit is None


def test_matching_builds_no_pairs(spark, monkeypatch):
    """Many candidates and events of one day: equal ones queue up, in one pass instead of a round for each of them."""
    rng = random.Random(3)
    words = ["call", "plan", ""]
    cands = [(rng.choice("ab"), o, rng.choice(["Call x", "PLAN", "call plan", None]), rng.randrange(0, 720, 40), rng.randrange(2)) for o in range(1500)]
    cands += [("a", o, "call", 300, 1) for o in range(40)]  # numbers that stand twice are one candidate
    truth = [(rng.choice("ab"), o, rng.choice(words), rng.choice([None, *range(0, 720, 60)]), rng.choice([None, 45, 200]), rng.randrange(2)) for o in range(300)]
    truth += [("b", o, "plan", 100, 90, 0) for o in range(30)]
    cand = spark.createDataFrame(cands, "name string, cand_ord long, title string, m int, d int").select(
        "name", "cand_ord", "title", F.lit(None).cast("string").alias("evidence"),
        F.expr("timestamp'2026-01-01 16:00:00' + make_interval(0, 0, 0, d, 0, m)").alias("start_ts"))
    expected = spark.createDataFrame(truth, "name string, exp_ord long, title_contains string, m int, tolerance_minutes int, d int").select(
        "name", "exp_ord", "title_contains", F.expr("date_add(date'2026-01-02', d)").alias("start_date"),
        F.expr("format_string('%02d:%02d', m div 60, m % 60)").alias("_t"), "m", "tolerance_minutes").withColumn(
        "start_time", F.when(F.col("m").isNotNull(), F.col("_t")))
    fits = sorted({(n, o, e) for n, o, t, m, d in cands for k, e, w, want, tol, day in truth
                   if n == k and d == day and w in (t or "").lower() and (want is None or abs(want - m) <= (tol or 0))})
    want, taken, used = [], set(), set()
    for n, o, e in fits:
        if (n, o) not in taken and (n, e) not in used:
            taken.add((n, o))
            used.add((n, e))
            want.append((n, o, e))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("matching", "")
    monkeypatch.setattr(evaluate._Free, "REMEMBERED", 3)
    found = evaluate.match_truth(cand, expected)
    assert len(jobs.getJobIdsForGroup("matching")) == 0  # no rounds
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in found.collect()) == want
