import datetime

import pytest
from moments import at
from pyspark.sql import functions as F

from inboxlake.operators import customer as op

AS_OF = "2024-01-31 00:00:00"
NOW = at("2024-01-31")


def ago(hours):
    return NOW - datetime.timedelta(hours=hours)


@pytest.fixture(scope="module")
def inbox(table):
    day = 24
    return {
        "messages": table(
            "messages",
            dict(id=1, author_id="1", direction="entrada", text="I am Ana@Mail.example, or ana2@mail.example. ana@mail.example", message_id="m1", created_at=ago(1)),
            dict(id=2, author_id="1", direction="saida", text="write to shop@mail.example", message_id="m2", created_at=ago(2)),
            dict(id=3, author_id="2", direction="entrada", text="shared ana2@mail.example", message_id="m3", created_at=ago(3)),
        ),
        "case_state": table(
            "case_state",
            dict(id=1, brand="brand_es", conversation_id="1", state="s1", given_email=" Given@Mail.example ", updated_at=ago(5)),
            dict(id=2, brand="brand_en", conversation_id="1", state="s2", given_email="  ", updated_at=ago(4)),
        ),
        "refunds": table(
            "refunds",
            dict(id=1, author_id="1", email="Refund@mail.example", created_at=ago(3)),
            dict(id=2, author_id=None, email="REFUND@mail.example", created_at=ago(2)),
            dict(id=3, author_id="1", email="ana@mail.example", created_at=ago(1)),
            dict(id=4, author_id="9", email=None, created_at=ago(1)),
        ),
        "purchases": table(
            "purchases",
            dict(transaction="T1", email="ANA@mail.example", product_id=1, status="APPROVED", approved_ms=1000, registered_at=ago(9),
                 raw='{"data":{"purchase":{"payment":{"type":"PIX"},"checkout_country":{"iso":"BR"}},"buyer":{"address":{"country_iso":"MX"}}}}'),
            dict(transaction="T2", email="ana2@mail.example", product_id=2, status="CANCELLED", approved_ms=None, registered_at=ago(8), raw="not json"),
            dict(transaction="T3", email="ana2@mail.example", product_id=3, status=None, approved_ms=2000, registered_at=ago(7),
                 raw='{"data":{"buyer":{"address":{"country_iso":"MX"}}}}'),
            dict(transaction="T4", email="shop@mail.example", product_id=3, status="COMPLETED", approved_ms=2000, registered_at=ago(7)),
        ),
        "items": table(
            "items",
            dict(id=1, brand="b", title="one", file="f1", product_id=7, unlocked_by=[1, 2], active=True, position=2),
            dict(id=2, brand="b", title="two", file="f2", product_id=1, unlocked_by=[2, 3], active=True, position=1),
            dict(id=3, brand="b", title="off", file="f3", product_id=1, unlocked_by=[1], active=False, position=1),
            dict(id=4, brand="a", title="four", file="f4", product_id=1, unlocked_by=[1, 1], active=True, position=None),
        ),
        "accesses": table(
            "accesses",
            dict(event="download", file="f1", email="ANA2@mail.example", created_at=ago(6)),
            dict(event="download", file="f1", email="ana@mail.example", created_at=ago(4)),
            dict(event="login", file="f4", email="ana@mail.example", created_at=ago(3)),
            *[dict(event="login", email="ana@mail.example", created_at=ago(10 + i)) for i in range(20)],
        ),
        "purchase_checks": table("purchase_checks", dict(conversation_id="1", email_checked="x", api_response="{}", created_at=ago(1))),
        "reply_queue": table(
            "reply_queue",
            *[dict(id=i, channel="dm", ref="1", created_at=ago(i)) for i in range(1, 9)],
            *[dict(id=i, channel="comentario_publico", ref=f"m{i - 20}", created_at=ago(i)) for i in range(21, 24)],
            dict(id=50, channel="dm", ref="1", created_at=None),
        ),
        "pending_replies": table(
            "pending_replies", dict(ref="m1", text="p1", created_at=ago(day)), dict(ref="1", text="p2", created_at=ago(1)), dict(ref="m3", text="p3", created_at=ago(1))
        ),
        "pauses": table("pauses", dict(conversation_id="1", brand="x", reason="r", paused_until=ago(9))),
        "deliveries": table(
            "deliveries", dict(id=1, author_id="1", to_address="else@mail.example", files=["a"], created_at=ago(1)),
            dict(id=2, author_id=None, to_address="ANA@mail.example", files=["b"], created_at=ago(2)),
        ),
    }


def build(spark, inbox, requests):
    keyed = op.customer_requests(spark.createDataFrame(requests, "author_id string, brand string"))
    states = op.newest_state(keyed, inbox["case_state"])
    emails = op.known_emails(keyed, states, inbox["refunds"], inbox["messages"])
    bought = op.customer_purchases(emails, inbox["purchases"])
    refs = op.reply_refs(keyed, inbox["messages"])
    names = ["reply_queue", "pauses", "items", "accesses", "refunds", "purchase_checks", "pending_replies", "deliveries"]
    parts = op.sections(keyed, states, emails, bought, refs, *[inbox[n] for n in names])
    return op.customer_file(keyed, parts, AS_OF)


@pytest.fixture(scope="module")
def files(spark, inbox):
    rows = build(spark, inbox, [("1", None), ("1", "brand_es"), ("2", None), ("3", None)]).collect()
    return {(r["author_id"], r["brand"]): r for r in rows}


def test_state_follows_the_asked_brand(files):
    assert files["1", None]["state"]["state"] == "s2"
    assert files["1", "brand_es"]["state"]["state"] == "s1"


def test_emails_are_lowered_but_not_trimmed(files):
    written = ["ana2@mail.example", "ana@mail.example", "refund@mail.example"]
    assert files["1", None]["emails"] == written
    assert files["1", "brand_es"]["emails"] == [" given@mail.example ", *written]


def test_purchases(files):
    bought = files["1", None]["purchases"]
    # approved newest first, never approved last
    assert [(p["transaction"], p["paid"], p["payment"], p["country"]) for p in bought] == [
        ("T3", None, None, "MX"), ("T1", True, "PIX", "BR"), ("T2", False, None, None),
    ]
    assert bought[1]["approved_at"] == datetime.datetime(1970, 1, 1, 0, 0, 1)


def test_items_need_a_paid_product_and_are_listed_once(files):
    items = files["1", None]["items"]
    assert [(i["item_id"], i["downloaded_at"]) for i in items] == [(4, None), (1, ago(4).replace(tzinfo=None))]


def test_accesses_and_counts(files):
    r = files["1", None]
    assert len(r["accesses"]) == 15 and r["accesses"][0]["event"] == "login"
    assert (r["n_logins"], r["n_downloads"]) == (21, 2)
    assert (files["3", None]["n_logins"], files["3", None]["n_downloads"]) == (0, 0)


def test_refunds_by_author_or_email_once(files):
    assert [x["id"] for x in files["1", None]["refunds"]] == [3, 2, 1]


def test_queue_pending_checks_deliveries_pause(files):
    r = files["1", None]
    assert [q["id"] for q in r["queue"]] == [50, 1, 2, 3, 4, 5, 6, 7, 8, 21]
    assert [p["text"] for p in r["pending"]] == ["p2", "p1"]
    assert "api_response" not in r["checks"][0].asDict() and len(r["checks"]) == 1
    assert [d["id"] for d in r["deliveries"]] == [1, 2]
    assert r["pause"]["reason"] == "r"


def test_unknown_customer_has_empty_arrays(files):
    r = files["3", None]
    assert r["state"] is None and r["pause"] is None
    for name in ("emails", "purchases", "items", "accesses", "refunds", "checks", "queue", "pending", "deliveries"):
        assert r[name] == [], name


def test_a_shared_address_reaches_both(files):
    assert [p["transaction"] for p in files["2", None]["purchases"]] == ["T3", "T2"]


def test_one_customer_alone_is_the_same(spark, inbox, files):
    alone = build(spark, inbox, [("1", None)]).collect()
    assert [r.asDict(True) for r in alone] == [files["1", None].asDict(True)]


def test_a_long_file_is_one_row(spark, inbox, table):
    many = [dict(id=k, author_id="9", to_address="x@y.co", files=[str(k)], created_at=None) for k in range(3_000)]
    file = build(spark, inbox | {"deliveries": table("deliveries", *many)}, [("9", None)]).collect()
    assert len(file) == 1 and [d["id"] for d in file[0]["deliveries"]] == list(range(3_000))


def test_missing_author_and_negative_positions(spark, inbox):
    rows = build(spark, inbox, [(None, "brand_es"), ("brand_es", None)]).collect()
    assert {(r["author_id"], r["brand"]) for r in rows} == {(None, "brand_es"), ("brand_es", None)}
    numbers = spark.createDataFrame([(-12,), (-3,), (0,), (7,), (None,), (2**62,)], "n long")
    assert [r[0] for r in numbers.orderBy(op.sort_number(F.col("n"))).collect()] == [-12, -3, 0, 7, 2**62, None]


def test_no_nested_loops(spark, inbox):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = build(spark, inbox, [("1", None)])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_emails_in_text_are_all_matches(inbox, rows):
    found = op.emails_in_text(inbox["messages"])
    assert rows(found.filter(F.col("author_id") == "1"), "email") == [("Ana@Mail.example",), ("ana2@mail.example",), ("ana@mail.example",)]
