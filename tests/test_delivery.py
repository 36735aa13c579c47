import pytest
from pyspark.sql import functions as F

from inboxlake.operators import delivery as op

REQUEST = (
    "request_key string, author_id string, brand string, to_address string, lang string, name string, message string, "
    "products array<bigint>, item_ids array<bigint>, confirm boolean, justification string"
)


def request(key, **more):
    base = dict(request_key=key, author_id=key, brand="brand_en", to_address="A@b.co", lang=None, name=None, message=None, products=None, item_ids=None, confirm=None, justification=None)
    return tuple({**base, **more}.values())


@pytest.fixture(scope="module")
def items(table):
    return table(
        "items",
        dict(id=1, brand="brand_en", title="One <1>", bucket="pub", file="d/1.pdf", product_id=10, unlocked_by=[11, 11], active=True, section="principal", position=2),
        dict(id=2, brand="brand_en", title="Two", bucket="pub", file="d/2.pdf", product_id=12, unlocked_by=None, active=True, section="principal", position=1),
        dict(id=3, brand="brand_en", title="Off", bucket="pub", file="d/3.pdf", product_id=10, unlocked_by=[11], active=False, section="principal", position=1),
        dict(id=4, brand="brand_es", title="Other", bucket="key", file="d/4.pdf", product_id=10, unlocked_by=[11], active=True, section="principal", position=1),
        dict(id=5, brand="brand_en", title="Extra", bucket="key", file="d/5.pdf", product_id=13, unlocked_by=[], active=True, section="complemento", position=0),
    )


@pytest.fixture(scope="module")
def bought(spark):
    return spark.sql(
        "select 'paid' request_key, true paid, 'Ana Lee' name, timestamp '2024-01-01' approved_at, timestamp '2024-01-01' registered_at, 'T1' transaction union all "
        "select 'paid', true, 'Bob', timestamp '2023-01-01', timestamp '2024-01-01', 'T2' union all "
        "select 'unpaid', false, 'Cy', timestamp '2024-01-01', timestamp '2024-01-01', 'T3' union all "
        "select 'empty list', true, 'Di', null, timestamp '2024-01-01', 'T4'"
    )


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(
        [
            request("paid", name=" "), request("unpaid"), request("listed", products=[11, 11, 12, -1], item_ids=[2]),
            request("empty list", products=[-1]), request("manual", confirm=True, justification=" sure "), request("blank", confirm=True, justification=" \n"),
            request("unconfirmed", justification="sure"), request("some", confirm=True, justification="x", item_ids=[1, 99]),
            request("places", item_ids=[1]),
        ],
        REQUEST,
    )


@pytest.fixture(scope="module")
def decided(requests, bought):
    extra = bought.filter("request_key = 'paid'").withColumn("request_key", F.lit("places"))
    return op.decide(requests, bought.unionByName(extra))


def test_decision(decided):
    assert {r["request_key"]: r["base"] for r in decided.collect()} == {
        "paid": "compra", "unpaid": None, "listed": "compra", "empty list": None, "manual": "confirmacao_manual", "blank": None,
        "unconfirmed": None, "some": "confirmacao_manual", "places": "compra",
    }


@pytest.fixture(scope="module")
def linked(spark, decided, requests, items):
    rights = spark.createDataFrame([(k, i) for k in ("paid", "places") for i in (4, 1)], "request_key string, id long").join(items, "id")
    rights = rights.withColumnRenamed("id", "item_id")
    placed = op.deliverable_items(decided, rights, items)
    return op.with_links(op.chosen_items(placed, requests), "https://x/", ["pub"])


def test_items(linked, rows):
    assert rows(linked, "request_key", "item_id", "place") == sorted(
        [
            # by brand, position and id; entitlements are chosen by place, others by id
            ("paid", 1, 0), ("paid", 4, 1), ("places", 4, 1), ("listed", 2, 0), ("manual", 2, 0), ("manual", 1, 1), ("some", 1, 1),
        ],
        key=repr,
    )
    urls = {r["item_id"]: r["url"] for r in linked.collect()}
    assert urls[1] == "https://x/storage/v1/object/public/pub/d/1.pdf" and urls[4] is None


def test_requested_items(requests, items, rows):
    assert rows(op.requested_items(requests, items), "request_key", "item_id") == [("listed", 1), ("listed", 2)]


def test_address_language_name(spark, requests, bought):
    mails = spark.createDataFrame([(m,) for m in (" A@B.co ", "a@b.c", "a b@c.de", "a@b@c.de", None)], "to_address string")
    assert [(r[0], r[1]) for r in op.with_address(mails).collect()] == [("a@b.co", True), ("a@b.c", False), ("a b@c.de", False), ("a@b@c.de", False), (None, None)]
    langs = spark.createDataFrame([("pt", "brand_en"), ("fr", "brand_de"), (None, "brand_it"), ("", "x")], "l string, b string")
    assert [r[0] for r in langs.select(op.message_language(F.col("l"), F.col("b"))).collect()] == ["pt", "de", "it", "es"]
    names = {r["request_key"]: r["first_name"] for r in op.addressee(requests, bought).collect()}
    # a blank name is a name; without one the newest paid purchase tells, unless a list took its place
    assert (names["paid"], names["unpaid"], names["empty list"]) == ("", "", "")
    assert {r["request_key"]: r["first_name"] for r in op.addressee(requests.withColumn("name", F.lit(None)), bought).collect()}["paid"] == "Ana"


def test_message(linked, requests):
    asked = requests.withColumn("lang", F.lit("en")).withColumn("first_name", F.lit("Ann")).withColumn("message", F.lit(" a<b\nc "))
    r = op.rendered(asked, linked).filter("request_key = 'manual'").first()
    one, two = (f"https://x/storage/v1/object/public/pub/d/{i}.pdf" for i in (1, 2))
    assert r["subject"] == "Your Brand EN files" and r["files"] == ["Two", "One <1>"]
    assert r["plain"].startswith(f"Hi Ann\n\nHere are your files, as direct downloads. No platform, no password needed.\n\na<b\nc\n\nTwo: {two}\nOne <1>: {one}\n\nThese links")
    assert "<p>a&lt;b<br>c</p>" in r["html"] and f'<li>One &lt;1&gt; <a href="{one}">Download</a></li>' in r["html"]
    assert op.rendered(asked, linked).filter("request_key = 'manual'").count() == 1


def test_send_result(spark):
    df = spark.createDataFrame([(True, 200, "x"), (False, 500, "y" * 400), (None, 404, None)], "ok boolean, status int, body string")
    got = [r[0] for r in df.select(op.send_result(F.col("ok"), F.col("status"), F.col("body"))).collect()]
    assert got == ["ok", "resend 500: " + "y" * 300, "resend 404: {}"]
