"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from mailspark.queries import all_queries
from mailspark.session import build_session

HEADLINE = (
    "review_reasons_daily", "prefilter_verdicts", "rule_hits_iso", "slot_dedupe", "redact_pii", "clean_body_hash",
    "html_to_text_len", "parse_messages", "parse_ics", "exact_copies_canonical", "title_similarity_pairs",
    "thread_rebuild", "sender_rollup", "stats_snapshot", "mailbox_filters", "conflict_siblings", "command_effects",
    "upsert_protected", "arrival_actions", "reconcile_verdicts", "audit_suspicion", "digest_daily", "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEM", "16g"), "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds = all_queries(), {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
