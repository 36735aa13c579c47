"""Headline queries, timed. Prints one JSON line.

The inbox tables are derived from the test tables and written as parquet first
(not timed); then each query runs ``BENCH_RUNS`` times after one warm-up and the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from inboxlake.operators import context, stuck, threads
from inboxlake.plans import actions as action_plans
from inboxlake.plans import context as context_plans
from inboxlake.plans import customer as customer_plans
from inboxlake.plans import delivery as delivery_plans
from inboxlake.functions.language import detect_language
from inboxlake.operators import actions
from inboxlake.sources.derived import AS_OF, BASE_TABLES, DERIVATIONS, Inbox
from inboxlake.sources.tables import workspace

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


class Written:
    """The derived tables as parquet, several files each, read with a plain scan."""

    def __init__(self, spark: SparkSession, folder: str, out: str):
        self.spark, self.folder, self.out = spark, folder, out
        inbox = Inbox(spark, folder)
        for name in DERIVATIONS:
            getattr(inbox, name).repartition(int(CPUS)).write.parquet(f"{out}/{name}")

    def __getattr__(self, name: str):
        path = f"{self.folder}/{name}.parquet" if name in BASE_TABLES else f"{self.out}/{name}"
        return self.spark.read.parquet(path)


def headline(t) -> dict:
    from pyspark.sql import functions as F

    return {
        "A06_waiting_since": lambda: threads.waiting_threads(t.messages, t.reply_queue, AS_OF, 7),
        "A19_queue": lambda: threads.queue(t.messages, t.reply_queue, t.case_state, t.pauses, AS_OF, 7),
        "A19_queue_30_days": lambda: threads.queue(t.messages, t.reply_queue, t.case_state, t.pauses, AS_OF, 30),
        "B07_stuck_cases": lambda: stuck.stuck_cases(t.case_state, t.messages, t.reply_queue, t.purchases, AS_OF),
        "C03_known_emails": lambda: customer_plans.Parts(t).emails,
        "C06_last_download": lambda: customer_plans.customer_items(t),
        "C15_customer_file": lambda: customer_plans.Parts(t, folder=workspace(t.spark)).file(),
        "D01_language": lambda: t.messages.select("id", detect_language(F.col("text"), F.col("brand")).alias("lang")),
        "E01_reply_validation": lambda: actions.validate_replies(t.actions_reply, t.messages),
        "E10_comment_delete": lambda: action_plans.comment_delete(t),
        "F10_rendered_message": lambda: delivery_plans.rendered(t),
        "F13_reply_transcript": lambda: context.transcript(t.messages),
        "F17_ranked_corrections": lambda: context.ranked_corrections(t.suggest_requests, t.corrections),
        "F19_case_context": lambda: context_plans.case_texts(t),
        "F20_translation_backlog": lambda: context.translation_backlog(t.messages),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("inboxlake-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.time()
    tables = Written(spark, FOLDER, tempfile.mkdtemp(prefix="inboxlake-bench-"))
    print(f"tables written in {time.time() - started:.1f} s", file=sys.stderr)
    only = sys.argv[1:]
    seconds = {}
    for name, build in headline(tables).items():
        if only and not any(name.startswith(prefix) for prefix in only):
            continue
        times = []
        for _ in range(RUNS + 1):
            started = time.time()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(x, 2) for x in times], file=sys.stderr)
    scale = FOLDER.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
