import datetime

import pytest
from moments import at
from pyspark.sql import functions as F

from inboxlake.constants import COMMENT_CHANNELS, MODERATION_BRANDS
from inboxlake.operators import actions as op

AS_OF = "2024-01-31 00:00:00"
NOW = datetime.datetime(2024, 1, 31)
REF = "1" * 17
REPLY = "seq long, brand string, channel string, ref string, text string, by_whom string"

RULES = [
    (("brand_xx", "dm", REF, "hi"), "brand"),
    (("brand_es", "fax", REF, "hi"), "channel"),
    (("brand_es", "dm", REF, "   "), "empty"),
    (("brand_es", "dm", REF, None), "empty"),
    (("brand_es", "dm", REF, "x" * 1001), "too_long"),
    (("brand_es", "dm", REF, "  " + "x" * 1000), None),
    (("brand_es", "dm", REF, "see Banned-Domain.example"), "banned_domain"),
    (("brand_es", "dm", "123", "hi"), "dm_ref"),
    (("brand_es", "comentario_publico", "1" * 14, "hi"), "comment_ref"),
    (("brand_es", "comentario_privado", "9" * 17, "hi"), "comment_missing"),
    (("brand_es", "comentario_privado", "2" * 17, "hi"), "comment_missing"),  # a Facebook comment
    (("brand_es", "comentario_publico", REF, "1\n2\n3\n4"), "too_many_lines"),
    (("brand_es", "comentario_privado", REF, "1\n2\n3\n4"), None),
    (("brand_es", "comentario_publico", REF, "1\n2\n3"), None),
    (("brand_es", "comentario_publico", REF, "go to SHOP.COM now"), "public_link"),
    (("brand_es", "comentario_publico", REF, "say a.community"), None),  # the ending needs a word border
    (("brand_es", "comentario_publico", REF, "HTTP://x"), "public_link"),
    (("brand_es", "dm", REF, "shop.com"), None),
    ((None, "dm", REF, "hi"), None),  # a missing value slips through "not in", as in SQL
]


@pytest.fixture(scope="module")
def messages(table):
    return table(
        "messages",
        dict(id=1, channel="comentario", brand="brand_es", message_id=REF, direction="entrada", author="", author_id="a", text="t" * 200, created_at=at("2024-01-01")),
        dict(id=2, channel="comentario_fb", brand="brand_es", message_id="2" * 17, direction="entrada", author="ana", author_id="a", text=None, created_at=at("2024-01-02")),
        dict(id=3, channel="comentario", brand="brand_es", message_id="3" * 17, direction="entrada", author="ann", author_id="a", text="gone", created_at=at("2024-01-03"), deleted_at=at("2024-01-04")),
        dict(id=4, channel="dm", brand="brand_es", message_id="4" * 17, direction="saida", author=None, author_id="b", text="out", created_at=at("2024-01-03")),
    )


def test_reply_rules(spark, messages):
    actions = spark.createDataFrame([(i, *a, "op") for i, (a, _) in enumerate(RULES)], REPLY)
    found = {r["seq"]: r["error"] for r in op.validate_replies(actions, messages).collect()}
    assert found == {i: e for i, (_, e) in enumerate(RULES)}


def test_upsert_keeps_the_id_and_clears_the_sending(spark, table, rows):
    queue = table("reply_queue", dict(id=5, brand="brand_en", channel="dm", ref="a", text="old", sent_at=at("2024-01-01"), result="ok"), dict(id=6, channel="dm", ref="z", text="kept", result="ok"))
    accepted = spark.createDataFrame([(1, "brand_es", "dm", "a", "first", "x"), (2, "brand_it", "dm", "a", "last", "y"), (3, "brand_es", "dm", "n", "new", "x"), (4, "brand_es", "dm", "n", "new2", "x")], REPLY)
    once = op.upsert_replies(queue, accepted, AS_OF, 100)
    expected = [(5, "brand_it", "a", "last", "tela:y", None), (6, None, "z", "kept", None, "ok"), (103, "brand_es", "n", "new2", "tela:x", None)]
    assert rows(once, "id", "brand", "ref", "text", "origin", "result") == sorted(expected, key=repr)
    # a replay changes nothing
    assert rows(op.upsert_replies(once, accepted, AS_OF, 100)) == rows(once)


def test_cancel_only_unsent_and_once(spark, table, rows):
    queue = table("reply_queue", dict(id=1, sent_at=None), dict(id=2, sent_at=at("2024-01-01")))
    cancels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 99)], "seq long, target_id long")
    kept, outcome = op.cancel_replies(queue, cancels)
    assert rows(kept, "id") == [(2,)]
    assert rows(outcome, "seq", "done") == [(1, True), (2, False), (3, False), (4, False)]


STATE = "seq long, conversation_id string, brand string, value string, author string, by_whom string"


def test_states_update_every_row_or_add_one(spark, table, rows):
    states = table("case_state", dict(id=1, conversation_id="a", brand="b", state="x", updated_at=at("2024-01-01")), dict(id=2, conversation_id="a", brand="b", state="y"), dict(id=3, conversation_id="a", brand="c", state="z"))
    log = [(1, "a", "b", "bogus", None, "op"), (2, "a", "b", "resolvido", None, "op"), (3, "n", "b", "aguardando_email", "first", "op"), (4, "n", "b", "resolvido", "second", "op2")]
    table_after, rejected = op.set_states(states, spark.createDataFrame(log, STATE), AS_OF, 100)
    assert rows(table_after, "id", "state") == [(1, "resolvido"), (103, "resolvido"), (2, "resolvido"), (3, "z")]
    added = table_after.filter("id = 103").first()
    assert (added["author"], added["context"]) == ("first", '{"origem":"tela","por":"op"}')
    assert table_after.filter("id = 1").first()["updated_at"] == datetime.datetime(2024, 1, 1)
    assert rows(rejected, "seq", "error") == [(1, "state")]


PAUSE = "seq long, conversation_id string, brand string, hours int, author string, by_whom string"


def test_pauses_fold_in_log_order(spark, table):
    pauses = table("pauses", dict(conversation_id="kept", author="k", reason="r"), dict(conversation_id="up", brand="old", author="old"), dict(conversation_id="off", author="o"), dict(conversation_id="again", author="o"))
    log = [
        (1, "up", "new", 400, None, "op"),  # two weeks at most, the old author stays
        (2, "off", "other", 5, "x", "op"), (3, "off", "any", 0, None, "op"),
        (4, "again", "b", None, None, "op"), (5, "again", "b", 2, None, "op"),  # the author went with the end
        (6, "fresh", "b", 1, "first", "op"), (7, "fresh", "b", 3, None, "op"),
        (8, "cut", "b", 1, "lost", "op"), (9, "cut", "b", -1, None, "op"), (10, "cut", "b", 1, "new", "op"), (11, "cut", "b", 1, None, "op"),
    ]
    after = {r["conversation_id"]: r for r in op.set_pauses(pauses, spark.createDataFrame(log, PAUSE), AS_OF).collect()}
    assert set(after) == {"kept", "up", "again", "fresh", "cut"}
    assert (after["up"]["brand"], after["up"]["author"], after["up"]["paused_until"]) == ("new", "old", NOW + datetime.timedelta(hours=336))
    assert after["again"]["author"] is None
    assert (after["fresh"]["author"], after["fresh"]["paused_until"]) == ("first", NOW + datetime.timedelta(hours=3))
    assert after["cut"]["author"] == "new" and after["kept"]["reason"] == "r"
    assert after["up"]["reason"] == "humano atendendo pela tela (op)"


def test_refunds(spark):
    log = spark.sql(
        "select 1L seq, 'b' brand, 'dm' channel, null author, 'a' author_id, 'X@Y' email, array('t') transactions, 1.5bd total, 'USD' currency, '' reason, "
        "'perguntado' reason_source, true guided, 'n' note, 'op' by_whom union all "
        "select 2, 'b', 'dm', null, 'a', '', null, null, null, 'r', 'bogus', false, '', 'op' union all "
        "select 3, 'b', 'dm', null, 'a', '', null, null, null, 'r', null, null, '', 'op'"
    )
    added, rejected = op.register_refunds(log, AS_OF, 10)
    found = {r["id"]: r for r in added.collect()}
    assert set(found) == {11, 13} and [r["seq"] for r in rejected.collect()] == [2]
    assert (found[11]["email"], found[11]["reason"], found[11]["guided_at"], found[11]["note"]) == ("x@y", None, NOW, "n | registrado pela tela por op")
    assert (found[13]["email"], found[13]["guided_at"], found[13]["note"]) == (None, None, "registrado pela tela por op")


def test_answered_outside_clears_the_thread(spark, messages):
    log = spark.createDataFrame([(1, "brand_es", "dm", "a", "", "op"), (2, "brand_es", "fax", "a", None, "op")], "seq long, brand string, channel string, author_id string, note string, by_whom string")
    added, rejected = op.answered_outside(messages, log, AS_OF, 100)
    r = added.first()
    assert (r["id"], r["author"], r["direction"], r["category"], r["text"]) == (101, "ann", "saida", "HUMANO", "[respondido à mão no Instagram por op]")
    assert added.columns == messages.columns and rejected.count() == 1


MODERATION = "seq long, kind string, message_id string, brand string, channel string, author_id string, author string, by_whom string"


def test_moderation(spark, messages):
    log = [
        (1, "hide", REF, "brand_es", "comentario", "a", "", "op"),
        (2, "delete", REF, "brand_es", "comentario", "a", None, "op"),
        (3, "delete", REF, "brand_es", "comentario", "a", None, "op"),
        (4, "show", REF, "brand_es", "comentario", "a", None, "op"),
        (5, "delete", "3" * 17, "brand_es", "comentario", "a", None, "op"),
        (6, "hide", "3" * 17, "brand_es", "comentario", "a", None, "op"),
        (7, "delete", "4" * 17, "brand_es", "comentario", "b", None, "op"),  # only inbound rows
        (8, "delete", REF, "brand_de", "comentario", "a", None, "op"),
        (9, "delete", REF, "brand_es", "dm", "a", None, "op"),
        (10, "delete", REF, "brand_es", "comentario", None, None, "op"),
        (11, "show", "2" * 17, "brand_es", "comentario_fb", "a", "given", "op"),
    ]
    after, outcome = op.moderate_comments(messages, spark.createDataFrame(log, MODERATION), AS_OF, 100, MODERATION_BRANDS, COMMENT_CHANNELS)
    assert {r["seq"]: r["outcome"] for r in outcome.collect()} == {
        1: "done", 2: "done", 3: "already_deleted", 4: "conflict", 5: "already_deleted", 6: "conflict", 7: "not_found", 8: "brand",
        9: "channel", 10: "missing_field", 11: "done",
    }
    found = {r["id"]: r for r in after.collect()}
    assert set(found) == {1, 2, 3, 4, 101, 102, 111}
    assert (found[1]["deleted_at"], found[1]["hidden_at"]) == (NOW, NOW)
    assert found[3]["deleted_at"] == datetime.datetime(2024, 1, 4) and found[2]["hidden_at"] is None
    assert found[101]["text"] == '[à mão por op] comentário ocultado pela tela: "' + "t" * 120 + '"'
    assert found[102]["text"].startswith("[respondido à mão por op] comentário apagado pela tela: ") and found[102]["author"] == "ann"
    assert (found[111]["text"], found[111]["author"]) == ('[à mão por op] comentário reexibido pela tela: ""', "given")


def test_facts(spark, table, rows):
    facts = table("facts", dict(id=1, topic="old", text="a", active=True), dict(id=2, topic="t", text="b", active=False))
    log = spark.createDataFrame(
        [(1, 1, "new", " x ", "op"), (2, 1, "  ", "y", "op2"), (3, None, " ", "z", "op"), (4, 1, "n", "  ", "op"), (5, 77, "n", "lost", "op")],
        "seq long, target_id long, topic string, text string, by_whom string",
    )
    after, rejected = op.save_facts(facts, log, AS_OF, 100)
    assert rows(after, "id", "topic", "text", "updated_by") == sorted([(1, "new", "y", "op2"), (2, "t", "b", None), (103, "geral", "z", "op")], key=repr)
    assert rows(rejected, "seq") == [(4,)]
    off, outcome = op.delete_facts(facts, spark.createDataFrame([(1, 1, "op"), (2, 1, "op"), (3, 2, "op")], "seq long, target_id long, by_whom string"), AS_OF)
    assert rows(off, "id", "active") == [(1, False), (2, False)]
    assert rows(outcome, "seq", "done") == [(1, True), (2, False), (3, False)]


def test_summaries_translations_suggestions(spark, table, messages, rows):
    old = spark.createDataFrame([("a", "b", "old"), ("z", "b", "kept")], "author_id string, brand string, summary string")
    new = spark.createDataFrame([(1, "a", "b", "first"), (2, "a", "b", "last"), (3, "n", "b", "new")], "seq long, author_id string, brand string, summary string")
    assert rows(op.upsert_summaries(old, new)) == [("a", "b", "last"), ("n", "b", "new"), ("z", "b", "kept")]
    wanted = spark.createDataFrame([(1, 0, ""), (1, 1, " "), (1, 2, ""), (2, 0, ""), (2, 1, " "), (3, 0, "")], "id long, part int, lead string")
    parts = [(1, 1, 1, "dois "), (2, 1, 0, "old"), (5, 1, 0, " um\n"), (3, 1, 2, "três"), (4, 2, 0, "half"), (6, 3, 0, "  "), (7, 4, 0, "no")]
    made = spark.createDataFrame(parts, "seq long, id long, part int, pt string")
    assert rows(op.write_translations(messages, wanted, made), "id", "text_pt") == [(1, "um doistrês"), (2, None), (3, None), (4, None)]
    produced = spark.sql(
        "select 1L seq, 'a' author_id, 'b' brand, 'dm' channel, 'en' lang, 'melhorar' mode, 'i' instruction, null draft, 's' suggestion, '' suggestion_pt, "
        "'m' model, 5L input_tokens, null cache_read, 2L cache_creation, null output_tokens, 'op' by_whom, 'C' categories"
    )
    r = op.log_suggestions(produced, AS_OF).first()
    assert (r["tokens_in"], r["tokens_out"]) == (7, 0)
    c = op.log_corrections(produced, messages, AS_OF, 100).first()
    # the newest inbound text that is not blank
    assert (c["question"], c["before"], c["after"], c["category"]) == ("gone", "", "s", "C")
    assert op.log_corrections(produced.withColumn("mode", F.lit("sugerir")), messages, AS_OF, 100).count() == 0


def test_states_of_a_hot_conversation(spark, table, rows, monkeypatch):
    """Splitting a hot key changes no result."""
    states = table("case_state", *[dict(id=i, conversation_id="hot" if i % 3 else f"c{i}", brand="b", state="x") for i in range(60)])
    log = spark.createDataFrame([(1, "hot", "b", "resolvido", None, "op")], STATE)
    plain = rows(op.set_states(states, log, AS_OF, 100)[0])
    real = op.skew_join
    monkeypatch.setattr(op, "skew_join", lambda *a, **k: real(*a, **k, hot_rows=5, salts=3))
    assert rows(op.set_states(states, log, AS_OF, 100)[0]) == plain
