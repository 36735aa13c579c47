"""Streams run to the end of their input give what the batch operators give."""

import datetime
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from moments import at

from inboxlake.operators import actions, threads
from inboxlake.operators.threads import THREAD
from inboxlake.sources.derived import Inbox, Streams
from inboxlake.sources.tables import SCHEMAS, workspace
from inboxlake.streaming import live

AS_OF = "2024-01-31 00:00:00"
NOW = at("2024-01-31")
FOLDER = "/root/testdata/sf0.001"


def _messages(n, seed):
    rnd = random.Random(seed)
    return [
        dict(
            id=i, brand="brand_es", channel=rnd.choice(["dm", "comentario"]), author_id="hot" if rnd.random() < 0.3 else rnd.choice("abc"),
            direction=rnd.choice(["entrada", "entrada", "saida"]), text=rnd.choice(["x", ""]), message_id=f"m{i}",
            created_at=NOW - datetime.timedelta(hours=rnd.randrange(200)), category=rnd.choice([None, "A"]),
        )
        for i in range(n)
    ]


def test_threads_in_any_order(spark, table, rows):
    rnd = random.Random(5)
    messages = table("messages", *_messages(120, 4))
    sends = table(
        "reply_queue",
        *[dict(id=i, brand="brand_es", channel="dm", ref=rnd.choice("abc"), sent_at=NOW - datetime.timedelta(hours=rnd.randrange(100))) for i in range(3)],
        *[dict(id=10 + i, brand="brand_es", channel="comentario_publico", ref=f"m{rnd.randrange(120)}", sent_at=NOW - datetime.timedelta(hours=rnd.randrange(100))) for i in range(10)],
        dict(id=50, brand="brand_es", channel="dm", ref="a", sent_at=None),
    )
    expected = threads.waiting_threads(messages, sends, AS_OF, 7)
    folder = workspace(spark)
    # sends arrive with the first files, before most of the messages they answer
    messages.repartition(3).write.parquet(f"{folder}/in/messages")
    sends.coalesce(1).write.parquet(f"{folder}/in/queue")
    run_threads(spark, folder)
    found = rows(live.current_threads(spark, folder, AS_OF, 7), *COLUMNS)
    assert found == rows(expected, *COLUMNS) and found


COLUMNS = [*THREAD, "last_in", "last_out", "waiting_since", "n_unanswered", "n_media", "categories", "last_text", "last_message_id"]


def run_threads(spark, folder):
    def stream(name, schema):
        return spark.readStream.schema(SCHEMAS[schema]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/{name}")

    both = lambda: (stream("messages", "messages"), stream("queue", "reply_queue"))
    live.start_lookup(*both(), folder, availableNow=True).awaitTermination()
    query = live.start_threads(*both(), folder, availableNow=True)
    query.awaitTermination()
    return query


def test_late_sends_a_moving_clock_and_no_reread(spark, table, rows):
    """Input comes in three runs; the last has answers to earlier messages, and the clock of the view moves on."""
    folder = workspace(spark)
    every, queue = [], []
    for k in range(3):
        some = [m | {"id": 1000 * k + m["id"], "message_id": f"m{1000 * k + m['id']}"} for m in _messages(60, 20 + k)]
        sends = [dict(id=100 * k + i, brand="brand_es", channel="comentario_publico", ref=f"m{1000 * (k - 1) + i}", sent_at=NOW - datetime.timedelta(hours=30 * i)) for i in range(5)]
        every, queue = every + some, queue + sends
        table("messages", *some).coalesce(1).write.mode("append").parquet(f"{folder}/in/messages")
        table("reply_queue", *sends).coalesce(1).write.mode("append").parquet(f"{folder}/in/queue")
        query = run_threads(spark, folder)
        read = sum(p["numInputRows"] for p in query.recentProgress)
        assert read <= len(some) + 2 * len(sends) + 5
        for as_of in (AS_OF, "2024-02-03 00:00:00"):
            expected = threads.waiting_threads(table("messages", *every), table("reply_queue", *queue), as_of, 7)
            assert rows(live.current_threads(spark, folder, as_of, 7), *COLUMNS) == rows(expected, *COLUMNS)


def outbox(spark, folder):
    stream = spark.readStream.schema(live.ACCEPTED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    said = spark.readStream.schema(SCHEMAS["messages"]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/messages")
    live.start_outbox(stream, said, folder, availableNow=True).awaitTermination()


def test_outbox(spark, table, rows):
    messages = table("messages", dict(id=1, channel="comentario", message_id="1" * 17))
    queue = table("reply_queue", dict(id=7, brand="brand_en", channel="dm", ref="5" * 12, text="old", result="ok"))
    data = [(i, "brand_es", "dm", str(5 + i % 3) * 12, f"text {i}", "op") for i in range(9)] + [(20, "brand_xx", "dm", "5" * 12, "bad", "op")]
    replies = spark.createDataFrame(data, live.ACCEPTED)
    folder = workspace(spark)
    replies.repartition(3).write.parquet(f"{folder}/in")
    messages.write.parquet(f"{folder}/messages")
    outbox(spark, folder)
    accepted, rejected = actions.split_valid(actions.validate_replies(replies, messages))
    expected = actions.upsert_replies(queue, accepted, AS_OF, 100)
    assert rows(live.current_outbox(spark, folder, queue, AS_OF, 100)) == rows(expected)
    assert rows(live.outbox_actions(spark, folder)[1], "seq", "error") == rows(rejected, "seq", "error") == [(20, "brand")]


def test_late_comments_and_no_reread(spark, table, rows):
    folder = workspace(spark)
    replies = [(1, "brand_es", "comentario_publico", "1" * 17, "hi", "op"), (2, "brand_es", "comentario_privado", "2" * 17, "hi", "op"), (3, "brand_es", "dm", "5" * 12, "hi", "op"), (4, "brand_es", "dm", None, "hi", "op")]
    spark.createDataFrame(replies, live.ACCEPTED).coalesce(1).write.parquet(f"{folder}/in")
    table("messages", dict(id=1, channel="dm", message_id="2" * 17)).coalesce(1).write.parquet(f"{folder}/messages")
    outbox(spark, folder)
    assert rows(live.outbox_actions(spark, folder)[0], "seq") == [(3,), (4,)] or rows(live.outbox_actions(spark, folder)[0], "seq") == [(3,)]
    assert [r for r in rows(live.outbox_actions(spark, folder)[1], "seq", "error") if r[0] < 3] == [(1, "comment_missing"), (2, "comment_missing")]
    # the comment arrives later, and another reply after it
    table("messages", dict(id=2, channel="comentario", message_id="1" * 17)).coalesce(1).write.mode("append").parquet(f"{folder}/messages")
    spark.createDataFrame([(9, "brand_es", "comentario_publico", "1" * 17, "again", "op")], live.ACCEPTED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    outbox(spark, folder)
    assert {(1,), (3,), (9,)} <= set(rows(live.outbox_actions(spark, folder)[0], "seq"))
    assert (2, "comment_missing") in rows(live.outbox_actions(spark, folder)[1], "seq", "error")


def test_replies_before_and_with_their_comments(spark, table, rows):
    """Whatever order both come in, the checks are those of the batch form; ids beyond 2 ** 53 stay exact."""
    big = 1 << 60
    messages = [dict(id=i, channel="comentario", message_id=str(10**16 + i)) for i in range(30)]
    replies = [(big + i, "brand_es", "comentario_publico", str(10**16 + i % 40), f"t{i}", "op") for i in range(80)]
    for first in (replies[:50], replies[30:]):
        folder = workspace(spark)
        rest = [r for r in replies if r not in first]
        spark.createDataFrame(first, live.ACCEPTED).coalesce(1).write.parquet(f"{folder}/in")
        table("messages", *messages[:9]).coalesce(1).write.parquet(f"{folder}/messages")
        outbox(spark, folder)
        spark.createDataFrame(rest, live.ACCEPTED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        table("messages", *messages[9:]).coalesce(1).write.mode("append").parquet(f"{folder}/messages")
        outbox(spark, folder)
        accepted, rejected = actions.split_valid(actions.validate_replies(spark.createDataFrame(replies, live.ACCEPTED), table("messages", *messages)))
        assert rows(live.outbox_actions(spark, folder)[0], "seq", "text") == rows(accepted, "seq", "text")
        assert rows(live.outbox_actions(spark, folder)[1], "seq", "error") == rows(rejected, "seq", "error")


def test_hot_thread_spreads_and_windows_close(spark, table, rows):
    folder = workspace(spark)
    hot = [dict(id=i, brand="brand_es", channel="dm", author_id="hot", direction="entrada", text="x", created_at=NOW - datetime.timedelta(minutes=i)) for i in range(400)]
    early = [dict(id=900 + i, brand="brand_es", channel="dm", author_id=f"a{i}", direction="entrada", text="x", created_at=NOW - datetime.timedelta(days=20 + i)) for i in range(4)]
    later = [dict(id=2000, brand="brand_es", channel="dm", author_id="z", direction="entrada", text="x", created_at=NOW + datetime.timedelta(days=45))]
    table("reply_queue").write.parquet(f"{folder}/in/queue")
    expected = threads.waiting_threads(table("messages", *hot, *early), table("reply_queue"), AS_OF, 7)
    table("messages", *hot, *early).coalesce(1).write.parquet(f"{folder}/in/messages")
    run_threads(spark, folder)
    assert rows(live.current_threads(spark, folder, AS_OF, 7), *COLUMNS) == rows(expected, *COLUMNS)
    parts = live.snapshots.read(spark, f"{folder}/threads", f"{live.PARTS}, days int").where("author_id = 'hot'")
    assert parts.count() > live.SALTS and max(r[0] for r in parts.selectExpr("size(open)").collect()) < 100
    with pytest.raises(ValueError):
        live.current_threads(spark, folder, AS_OF, 8)
    # the watermark moves past every window; the newest message of each thread is told with both
    table("messages", *later).coalesce(1).write.mode("append").parquet(f"{folder}/in/messages")
    run_threads(spark, folder)
    closed = rows(live.closed_windows(spark, folder), "author_id", "last_in", "hours")
    newest = {"hot": hot[0]["created_at"]} | {m["author_id"]: m["created_at"] for m in early}
    assert {(a, h) for a, _, h in closed} == {(a, h) for a in newest for h in (24, 168)}
    assert {(a, t.replace(tzinfo=datetime.timezone.utc) if t.tzinfo is None else t) for a, t, _ in closed} == set(newest.items())
    # what is over is dropped from the table of parts
    left = live.snapshots.read(spark, f"{folder}/threads", f"{live.PARTS}, days int")
    assert rows(left.where("size(open) > 0"), "author_id") == [("z",)]


def test_nothing_runs_once_a_key(spark, table):
    """Ids are joined by Spark's stream join, events are aggregated as batches: no plan calls Python."""
    folder = workspace(spark)
    table("messages", *_messages(40, 7)).coalesce(1).write.parquet(f"{folder}/in/messages")
    table("reply_queue", dict(id=1, brand="brand_es", channel="comentario_publico", ref="m3", sent_at=NOW)).coalesce(1).write.parquet(f"{folder}/in/queue")
    spark.createDataFrame([(1, "brand_es", "comentario_publico", "1" * 17, "hi", "op")], live.ACCEPTED).coalesce(1).write.parquet(f"{folder}/in/replies")
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{folder}/in/{name}")
    both = lambda: (stream("messages", SCHEMAS["messages"]), stream("queue", SCHEMAS["reply_queue"]))
    plans = []
    for start in (live.start_lookup, live.start_threads, lambda *a, **k: live.start_outbox(stream("replies", live.ACCEPTED), *a[:1], *a[2:], **k)):
        query = start(*both(), folder, availableNow=True)
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))
    assert not [p for p in plans for word in ("Python", "Pandas", "PySpark") if word in p]
    assert ["StreamingSymmetricHashJoin" in p for p in plans] == [True, False, True]


def test_a_repeated_batch_counts_once(spark, rows):
    """Two messages without id at one instant are two, also when their batch is run again over parts that have them already."""
    said = [("a", "brand_es", "dm", NOW, 0, name, "x", "in", False, "A", None, 10**15, 11574, 0) for name in ("Ann", "Ann", "Bob")]
    new = live._said(spark.createDataFrame(said, live.EVENTS), 3)
    once = live._merged(new.limit(0), new, 3)
    assert rows(once) == rows(live._merged(once, new, 3)) == rows(live._merged(live._merged(once, new, 3), new, 3))
    assert rows(once.selectExpr("size(open)", "names.name")) == [(3, ["Ann", "Bob"])]


def with_column(root, column):
    """Folders below ``root`` whose parquet files have the column."""
    files = [p for p in Path(root.removeprefix("file://")).rglob("*.parquet") if column in pq.read_schema(p).names]
    return {p.relative_to(root.removeprefix("file://")).parts[0] for p in files}


def test_texts_of_replies_are_written_once(spark, table, rows):
    folder = workspace(spark)
    data = [(i, "brand_es", "comentario_privado", str(10**16 + i % 9), f"text {i}" if i % 5 else "x" * 1001, "op") for i in range(40)]
    source = workspace(spark)
    spark.createDataFrame(data, live.ACCEPTED).repartition(4).write.parquet(f"{source}/in")
    table("messages", *[dict(id=i, channel="comentario", message_id=str(10**16 + i)) for i in range(6)]).repartition(3).write.parquet(f"{source}/messages")
    stream = spark.readStream.schema(live.ACCEPTED).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    said = spark.readStream.schema(SCHEMAS["messages"]).option("maxFilesPerTrigger", 1).parquet(f"{source}/messages")
    live.start_outbox(stream, said, folder, availableNow=True).awaitTermination()
    assert with_column(folder, "text") == {"changes"}
    assert rows(spark.read.parquet(f"{folder}/changes").where("text is not null"), "seq") == sorted([(i,) for i in range(40)], key=repr)
    accepted, rejected = live.outbox_actions(spark, folder)
    assert rows(accepted, "seq", "text") == sorted([(i, f"text {i}") for i in range(40) if i % 5 and i % 9 < 6], key=repr)
    assert {r["text"] for r in rejected.where("seq % 5 = 0").collect()} == {"x" * 1001}


def test_a_replaced_reply_waits_for_its_own_comment(spark, table, rows):
    folder = workspace(spark)
    for k, (ref, said) in enumerate([("1" * 17, "9" * 17), ("2" * 17, "8" * 17), ("3" * 17, "1" * 17)]):
        spark.createDataFrame([(1 if k < 2 else 7, "brand_es", "comentario_privado", ref, f"hi {k}", "op")], live.ACCEPTED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        table("messages", dict(id=k, channel="comentario", message_id=said)).coalesce(1).write.mode("append").parquet(f"{folder}/messages")
        outbox(spark, folder)
    assert rows(live.outbox_actions(spark, folder)[1], "seq", "ref", "error") == [(1, "2" * 17, "comment_missing"), (7, "3" * 17, "comment_missing")]


def test_tables_as_streams_are_the_tables(spark, rows):
    folder, inbox = workspace(spark), Inbox(spark, FOLDER)
    streams = Streams(spark, FOLDER, f"{folder}/in", {"events": "ts", "conversations": "conv_id", "customer": "-c_custkey"}, 6, 2)
    for name in ("messages", "actions_reply", "reply_queue"):
        sink = getattr(streams, name).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/at-{name}")
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(query.recentProgress) > 2
        expected = getattr(inbox, name)
        assert rows(spark.read.schema(expected.schema).parquet(f"{folder}/{name}")) == rows(expected)
    assert with_column(folder + "/in", "text") == {"conversations"}


def test_a_batch_writes_the_days_it_has(spark, table):
    """Parts of earlier days are left as they are, and names are told once a part."""
    folder = workspace(spark)
    table("reply_queue").write.parquet(f"{folder}/in/queue")
    written = []
    for k in range(2):
        some = [dict(id=100 * k + i, brand="brand_es", channel="dm", author_id=f"a{i}", author="Ann", direction="entrada", text="x", created_at=NOW - datetime.timedelta(days=5 - k, hours=2, minutes=i)) for i in range(60)]
        table("messages", *some).coalesce(1).write.mode("append").parquet(f"{folder}/in/messages")
        run_threads(spark, folder)
        files = sorted(Path(f"{folder}/threads".removeprefix("file://")).rglob("*.parquet"))
        written.append({p: p.stat().st_mtime_ns for p in files if pq.read_table(p, columns=["is_row"])["is_row"].to_pylist().count(True)})
    assert written[0] and written[0].items() <= written[1].items() and len(written[1]) > len(written[0])
    twice = [("a", "brand_es", "dm", NOW, i, "Ann", "x", "in", False, "A", None, 10**15 + i, 11574, 0) for i in range(2)]
    assert live._said(spark.createDataFrame(twice, live.EVENTS), 0).selectExpr("size(names)").first()[0] == 1
