import datetime
import random

import pytest
from moments import at
from pyspark.sql import functions as F

from inboxlake.functions import text
from inboxlake.operators import actions
from inboxlake.operators import context as op


def value(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "email,masked",
    [("john@x.com", "j***n@x.com"), ("jo@x.com", "j*@x.com"), ("j@x.com", "j*@x.com"), ("@x.com", "*@x.com"), ("none", "none"), (None, ""), ("joe@x@y", "j***e@x")],
)
def test_mask(spark, email, masked):
    assert value(spark, text.mask_email(F.col("e")), e=email) == masked


def test_small_helpers(spark):
    assert value(spark, text.trim_all(F.col("e")), e=" \n\t a b  ﻿") == "a b"
    assert value(spark, text.first_name(F.col("e")), e="  Ana  Maria ") == "Ana"
    assert value(spark, text.first_name(F.col("e")), e=None) == ""
    url = text.public_url(F.lit("https://x//"), F.lit("my files"), F.col("e"))
    assert value(spark, url, e="a b/c+d(é)~!'*.pdf") == "https://x/storage/v1/object/public/my%20files/a%20b/c%2Bd(%C3%A9)~!'*.pdf"
    assert value(spark, text.escape_html(F.col("e")), e="<a & \"b\" 'c'>") == "&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt;"
    assert value(spark, op.amount_text(F.col("e").cast("decimal(18,2)")), e="12.30") == "12.3"
    assert value(spark, op.amount_text(F.col("e").cast("decimal(18,2)")), e="100") == "100"
    assert value(spark, op.amount_text(F.col("e").cast("decimal(18,2)")), e="0.05") == "0.05"


@pytest.mark.parametrize("minutes,expected", [(3, 0.1), (21, 0.4), (2.9, 0.0), (-21, -0.4)])
def test_elapsed_rounds_half_away_from_zero(spark, minutes, expected):
    later = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)
    df = spark.createDataFrame([(later, at("2024-01-01"))], "a timestamp, b timestamp")
    assert float(df.select(text.elapsed(F.col("a"), F.col("b"), 3600)).first()[0]) == expected


def test_transcripts(table):
    messages = table(
        "messages",
        dict(id=1, author_id="a", direction="entrada", channel="dm", category="X", text=" hi ", created_at=at("2024-01-02T03:04:05")),
        dict(id=2, author_id="a", direction="saida", channel="dm", text="[note]", created_at=at("2024-01-02T03:05:00")),
        dict(id=3, author_id="a", direction="saida", channel="dm", text="\n", created_at=at("2024-01-02T03:06:00")),
        dict(id=4, author_id="a", direction="entrada", channel="comentario", text=None, created_at=at("2024-01-02T03:07:00"), hidden_at=at("2024-01-03")),
        dict(id=5, author_id="a", direction="entrada", channel="comentario", text="x", created_at=at("2024-01-02T03:08:00"), hidden_at=at("2024-01-03"), deleted_at=at("2024-01-03")),
    )
    reply = op.transcript(messages).first()
    assert reply["transcript"].split("\n") == [
        "[2024-01-02 03:04 · dm · X] CLIENTE: hi",
        "[2024-01-02 03:05 · dm] NÓS: [note]",
        "[2024-01-02 03:06 · dm] NÓS: [vazio]",
        "[2024-01-02 03:07 · comentario] CLIENTE: [mídia sem texto: imagem, print ou áudio; conteúdo desconhecido]",
        "[2024-01-02 03:08 · comentario] CLIENTE: x",
    ]
    assert op.summary_transcript(messages).first()["transcript"].split("\n") == [
        "[01-02 03:04 dm X] CLIENTE: hi",
        "[01-02 03:05 dm] REGISTRO INTERNO: [note]",
        "[01-02 03:06 dm] NÓS: [mídia sem texto]",
        "[01-02 03:07 comentario] CLIENTE: [mídia sem texto] (comentário oculto)",
        "[01-02 03:08 comentario] CLIENTE: x (comentário apagado)",
    ]
    two = op.transcript(messages, k=2).first()
    assert two["n_msgs"] == 2 and two["transcript"].startswith("[2024-01-02 03:07")


def test_delivery_lines(table, spark):
    base = dict(to_address="john@x.com", created_at=at("2024-01-02"))
    deliveries = table(
        "deliveries",
        dict(id=1, files=["a", "b", "c", "d", "e"], result="ok", by_whom="bot", **base),
        dict(id=2, files=["a"], result="resend 500: x", by_whom="ana", **base),
        dict(id=3, files=None, result=None, by_whom=None, **base),
    )
    lines = {r["id"]: r["line"] for r in op.lines(deliveries, lambda d: op.delivery_line(d, "dona")).collect()}
    assert lines[1] == "- 02/01/2024 · para j***n@x.com · 5 arquivo(s): a, b, c e mais 2 · entregue pela Resend · enviado pelo robô"
    assert lines[2] == "- 02/01/2024 · para j***n@x.com · 1 arquivo(s): a · FALHOU: resend 500: x · enviado à mão por dona"
    # without a result a delivery is printed as failed, yet counts as delivered
    assert lines[3] == "- 02/01/2024 · para j***n@x.com · 0 arquivo(s): ? · FALHOU: ? · enviado à mão por dona"
    summary = op.delivery_summary(deliveries.withColumn("request_key", F.lit("k"))).first()
    assert (summary["n_deliveries"], summary["n_delivered"], summary["last_to"]) == (3, 2, "j***n@x.com")


def test_corrections_against_a_plain_ranking(spark, table):
    rnd = random.Random(3)
    data = [
        dict(id=i, lang=rnd.choice(["es", "en", None]), channel=rnd.choice(["dm", "comentario_publico"]), instruction="i", before="b" * 300, after="a",
             is_rule=False, created_at=None if i == 7 else at("2024-01-01") + datetime.timedelta(hours=rnd.randrange(50)))
        for i in range(70)
    ]
    asked = [("1", "es", "dm", "brand_en"), ("2", "fr", "comentario_publico", None), ("3", None, "dm", "brand_en"), ("4", "fr", "fax", "x"), ("5", "", "fax", "brand_de")]
    requests = spark.createDataFrame(asked, "author_id string, lang string, channel string, brand string")
    far = at("2100-01-01")
    top = sorted(data, key=lambda c: (c["created_at"] or far, c["id"]), reverse=True)[:40]
    found = {r["author_id"]: [c["id"] for c in r["corrections"]] for r in op.ranked_corrections(requests, table("corrections", *data)).collect()}
    for author, lang, channel, brand in asked:
        lang = lang or {"brand_en": "en"}.get(brand, "es")
        match = [c for c in top if c["lang"] == lang or c["channel"] == channel]
        rest = [c for c in top if c not in match]
        assert found[author] == [c["id"] for c in (match + rest)[:25]], author
    plan = op.ranked_corrections(requests, table("corrections", *data))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_json_in_text(spark, rows):
    data = [
        (1, 'Sure! {"texto": " a ", "texto_pt": 5, "notas": null} bye {'), (2, "no object "), (3, "{broken}"), (4, None),
        (5, 'x {"texto": "a\\n}b"} '),
    ]
    outputs = spark.createDataFrame(data, "seq long, raw string")
    parsed = op.parsed_output(outputs, "raw", ["texto", "texto_pt", "notas"], ("notas", "raw!"))
    assert rows(parsed, "seq", "texto", "texto_pt", "notas") == [
        (1, "a", "5", ""), (2, "no object", "", "raw!"), (3, "{broken}", "", "raw!"), (4, "", "", "raw!"), (5, "a\n}b", "", ""),
    ]


def test_translation_backlog(spark, table, rows):
    messages = table(
        "messages", dict(id=1, text="x" * 4001), dict(id=39, text="y"), dict(id=40, text="z", text_pt=""), dict(id=41, text=" \n"),
        dict(id=42, text=None, text_pt="done"), dict(id=0, text="no id"), dict(id=43, text="not asked"),
    )
    requested = spark.createDataFrame([(i,) for i in (1, 1, 39, 40, 41, 42, 0)], "id long")
    found = op.translation_backlog(messages, requested)
    assert rows(found.filter("not done"), "id", "batch", "part", F.length("text")) == [(1, 0, 0, 2000), (1, 0, 1, 2000), (1, 0, 2, 1), (39, 0, 0, 1), (40, 1, 0, 1)]
    assert rows(found.filter("done"), "id", "text") == [(42, "done")]


def test_parts_keep_words_and_white_space(spark, table, rows):
    texts = ["x" * 1999 + " " + "y" * 10, "x" * 2000 + " y", "x" * 2001 + " y", "a \n\u00a0 " * 900, " lead " + "word " * 1000 + "\t", "é" * 5000, "one", ("w" * 30 + "\n\n") * 300, "a" + " " * 3000 + "b"]
    messages = table("messages", *[dict(id=i + 1, text=x) for i, x in enumerate(texts)])
    parts = op.translation_backlog(messages)
    assert rows(parts.filter("id = 1"), "part", "lead", F.length("text")) == [(0, "", 1999), (1, " ", 10)]
    for r in parts.collect():
        assert 0 < len(r.text) <= 2000 and r.text == r.text.strip() and not r.lead.strip()
    made = parts.select(F.lit(1).cast("long").alias("seq"), "id", "part", F.col("text").alias("pt"))
    assert rows(actions.write_translations(messages, parts, made), "id", "text_pt") == [(i + 1, x.strip()) for i, x in enumerate(texts)]


def test_summary_backlog(spark, table, rows):
    messages = table("messages", *[dict(id=i, author_id="a", created_at=at("2024-01-02")) for i in range(100)], dict(id=200, author_id="b", created_at=at("2024-01-02")))
    summaries = table("summaries", dict(author_id="a", brand="x", covers_until=at("2024-01-02")), dict(author_id="a", brand="y", covers_until=at("2024-01-01")))
    requests = spark.createDataFrame(
        [("a", "x", False), ("a", "y", None), ("a", "z", False), ("b", "x", False), ("none", "x", True), ("a", "x2", True)], "author_id string, brand string, force boolean"
    )
    found = op.summary_backlog(requests, messages, summaries)
    assert rows(found, "author_id", "brand", "n_msgs", "stale") == [("a", "x", 80, False), ("a", "x2", 80, True), ("a", "y", 80, True), ("a", "z", 80, True), ("b", "x", 1, True), ("none", "x", 0, False)]
    assert rows(found.filter("outcome = 'no_messages'"), "author_id") == [("none",)]
    forced = requests.withColumn("force", F.lit(True))
    assert op.summary_backlog(forced, messages, summaries).filter("not stale").count() == 1
