"""Texts are looked up for the rows that need them, files hold the sections asked for, and pairs are dealt to many tasks."""

import pytest
from moments import at
from pyspark.sql import functions as F

from inboxlake.constants import COMMENT_CHANNELS, MODERATION_BRANDS
from inboxlake.operators import actions, context, customer, delivery, threads
from inboxlake.operators.skew import spread_pairs
from inboxlake.sources.derived import Inbox

FOLDER = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def inbox(spark):
    return Inbox(spark, FOLDER)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_looked_up_rows_are_those_of_a_join(inbox, rows):
    ids = inbox.messages.filter("id % 7 = 0").select("id")
    for how in ("left_semi", "left_anti"):
        assert rows(inbox.messages_of(ids, how)) == rows(inbox.messages.join(ids, "id", how).select(*inbox.messages.columns))
        replies = inbox.actions_reply
        assert rows(inbox.replies_of(ids, how)) == rows(replies.join(ids.toDF("seq"), "seq", how).select(*replies.columns))


def test_same_results_with_lookups(inbox, rows):
    t = inbox
    assert rows(context.transcript(t.messages, k=3, fetch=t.messages_of)) == rows(context.transcript(t.messages, k=3))
    waits = [threads.waiting_threads(t.messages, t.reply_queue, AS_OF, 7, fetch=f) for f in (None, t.messages_of)]
    assert rows(waits[1].select(*waits[0].columns)) == rows(waits[0])
    checked = [actions.validate_replies(t.actions_reply, t.messages, fetch=f) for f in (None, t.replies_of)]
    assert rows(checked[1].select(*checked[0].columns)) == rows(checked[0])
    moderated = [actions.moderate_comments(t.messages, t.actions_moderation, AS_OF, 9 * 10**15, MODERATION_BRANDS, COMMENT_CHANNELS, f)[0] for f in (None, t.messages_of)]
    assert rows(moderated[1].select(*moderated[0].columns)) == rows(moderated[0])


def test_file_of_some_sections(spark, rows):
    keyed = customer.customer_requests(spark.createDataFrame([("a", "b")], "author_id string, brand string"))
    emails = keyed.select("request_key", "author_id", F.lit("x@y.co").alias("email"))
    file = customer.customer_file(keyed, {"emails": emails}, AS_OF)
    assert file.columns == ["as_of", "author_id", "brand", "emails"] and file.first()["emails"] == ["x@y.co"]


def test_pairs_of_one_key_are_dealt(spark):
    left, right = spark.range(300).selectExpr("'k' as k", "id as l"), spark.range(200).selectExpr("'k' as k", "id as r")
    pairs = spread_pairs(left, right, ["k"], "l", "r", side=4)
    assert pairs.distinct().count() == pairs.count() == 60_000
    assert "_a" in plan(pairs) and "_b" in plan(pairs)


def test_pairs_of_short_rows_stay_in_many_tasks(spark):
    """What comes in is small, so adaptive execution would make one task of it."""
    left, right = spark.range(300).selectExpr("string(id % 1) as k", "id as l"), spark.range(200).selectExpr("string(id % 1) as k", "id as r")
    pairs = spread_pairs(left, right, ["k"], "l", "r", side=4)
    sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 60_000


def test_file_of_some_columns(spark, inbox, rows):
    keyed = customer.customer_requests(inbox.requests)
    states = customer.newest_state(keyed, inbox.case_state)
    emails = customer.known_emails(keyed, states, inbox.refunds, inbox.messages)
    refs = customer.reply_refs(keyed, inbox.messages)
    parts = {"refunds": customer.customer_refunds(keyed, emails, inbox.refunds), "queue": customer.customer_queue(refs, inbox.reply_queue), "state": states}
    whole = customer.customer_file(keyed, parts, AS_OF)
    some = customer.customer_file(keyed, parts, AS_OF, {"refunds": ("id",), "queue": ("ref",), "state": ("state",)})
    shown = ["author_id", "brand", "refunds.id", "queue.ref", "state.state"]
    assert rows(some.select(*shown)) == rows(whole.select(*shown))
    assert some.select(F.explode("queue").alias("q")).select("q.*").columns == ["ref"]
    assert "reply " in plan(whole) and "reply " not in plan(some)  # the texts of replies are not made


def test_only_named_items_are_paired(spark, table, rows):
    items = table("items", *[dict(id=i, brand="b", title=f"t{i}", bucket="k", file="f", active=True, section="principal", position=i % 3) for i in range(50)])
    decided = spark.createDataFrame([("all", "b", None), ("some", "b", [3, 3, None, 99]), ("none", "b", [])], "request_key string, brand string, item_ids array<bigint>")
    decided = decided.withColumns({"base": F.lit("confirmacao_manual"), "listed": F.lit(False), "products": F.lit(None).cast("array<bigint>")})
    rights = table("items").select(F.lit("").alias("request_key"), F.col("id").alias("item_id"), *delivery.ITEM)
    every = delivery.chosen_items(delivery.deliverable_items(decided, rights, items), decided)
    few = delivery.deliverable_items(decided, rights, items, only_chosen=True)
    assert few.filter("request_key = 'some'").count() == 1
    assert rows(delivery.chosen_items(few, decided).select(*every.columns)) == rows(every) and every.count() == 101


def test_translations_meet_by_id_once(spark, table, rows):
    messages = table("messages", dict(id=1, text="a b"), dict(id=2, text="c"), dict(id=3, text="d"))
    sent = spark.createDataFrame([(1, 0, ""), (1, 1, " "), (2, 0, ""), (2, 1, " "), (3, None, "")], "id long, part int, lead string")
    back = spark.createDataFrame([(1, 1, 0, "A"), (2, 1, 0, "AA"), (3, 1, 1, "B"), (4, 2, 0, "C"), (5, 3, None, "D"), (6, 9, 0, "E")], "seq long, id long, part int, pt string")
    written = actions.write_translations(messages, sent, back)
    assert rows(written, "id", "text_pt") == [(1, "AA B"), (2, None), (3, None)]
    assert "hashpartitioning(id#" in plan(written) and not any("part#" in line for line in plan(written).split("\n") if "hashpartitioning" in line)


def test_lines_are_made_once_a_kind(spark, table):
    fixes = table("corrections", *[dict(id=i, lang=l, channel="dm", instruction=f"i{i}", is_rule=False, created_at=at("2024-01-01")) for i, l in enumerate(["en", "it", None])])
    asked = spark.createDataFrame([("a", "x", "it"), ("b", "dm", None)], "author_id string, channel string, lang string").withColumn("brand", F.lit("brand_es"))
    found = {r["author_id"]: [c["line"] for c in r["corrections"]] for r in context.ranked_corrections(asked, fixes).collect()}
    assert [x[-3:-1] for x in found["a"]] == ["i1", "i2", "i0"] and [x[-3:-1] for x in found["b"]] == ["i2", "i1", "i0"]
