"""Operator actions applied to table snapshots.

An action is a row of a log ordered by ``seq``. Each function takes a table and
actions and returns the new table (and, where actions can fail, the rejected
ones). Actions on one key apply in log order; many actions fold into one change
per key before anything is joined. New rows take ``first_id + seq`` as id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.constants import (
    BANNED_DOMAIN,
    COMMENT_REF,
    DM_REF,
    INBOUND,
    OPERATOR_STATES,
    OUTBOUND,
    OUTSIDE_CHANNELS,
    PAUSE_MAX_HOURS,
    PUBLIC_LINK,
    PUBLIC_MAX_LINES,
    REASON_SOURCES,
    RECORDS,
    REPLY_BRANDS,
    REPLY_CHANNELS,
    REPLY_MAX_CHARS,
)
from inboxlake.functions.text import blank_to_null, filled, instant, trim_all
from inboxlake.operators.skew import newest, newest_rows, skew_join


def _text(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


# --- replies --------------------------------------------------------------


def validate_replies(
    actions: DataFrame, messages: DataFrame, brands=REPLY_BRANDS, banned_domain: str = BANNED_DOMAIN, fetch=None
) -> DataFrame:
    """Add ``error``: the first broken rule of a reply, NULL when it is good. The text comes out trimmed.

    Comments are looked for without the texts. ``fetch`` gives the actions whose ``seq`` is (``left_semi``) or is not (``left_anti``) in a frame.
    """
    comments = messages.filter((F.col("channel") == "comentario") & F.col("message_id").isNotNull())
    refs = actions.filter(F.col("channel") != "dm").select("ref").distinct()
    known = comments.select(F.col("message_id").alias("ref")).join(refs, "ref", "left_semi").distinct()
    asked = actions.filter(F.col("channel") != "dm").select("seq", "ref")
    found = skew_join(asked, known, ["ref"], spread=["seq"]).select("seq")
    fetch = fetch or (lambda seqs, how: actions.join(seqs, "seq", how))
    marked = fetch(found, "left_semi").withColumn("_known", F.lit(True)).unionByName(fetch(found, "left_anti").withColumn("_known", F.lit(False)))
    return with_error(marked, F.col("_known"), brands, banned_domain).drop("_known")


def with_error(actions: DataFrame, known: Column, brands=REPLY_BRANDS, banned_domain: str = BANNED_DOMAIN) -> DataFrame:
    """``validate_replies`` for actions that carry whether their comment is ``known`` (null or false: no)."""
    checked = actions.withColumn("text", _text("text"))
    text, ref = F.col("text"), F.col("ref")
    direct, public = F.col("channel") == "dm", F.col("channel") == "comentario_publico"
    rules = (
        (~F.col("brand").isin(*brands), "brand"),
        (~F.col("channel").isin(*REPLY_CHANNELS), "channel"),
        (text == "", "empty"),
        (F.length(text) > REPLY_MAX_CHARS, "too_long"),
        (F.contains(F.lower(text), F.lit(banned_domain.lower())), "banned_domain"),
        (direct & ~ref.rlike(DM_REF), "dm_ref"),
        (~direct & ~ref.rlike(COMMENT_REF), "comment_ref"),
        (~direct & ~F.coalesce(known, F.lit(False)), "comment_missing"),
        (public & (F.size(F.split(text, "\n", -1)) > PUBLIC_MAX_LINES), "too_many_lines"),
        (public & text.rlike(PUBLIC_LINK), "public_link"),
    )
    error = F
    for broken, name in rules:
        error = error.when(broken, name)
    return checked.withColumn("error", error)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of actions with an ``error`` column."""
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def merged(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``table`` with the columns of its key's row of ``batch`` (one a key), and the rows of new keys.

    A full outer join could not broadcast a small batch; a left join and an anti join of the keys found can.
    """
    known = table.join(batch.select(*keys), keys, "left_semi").select(*keys).distinct()
    new = batch.join(known, keys, "left_anti")
    return table.join(batch, keys, "left").unionByName(new, allowMissingColumns=True)


def upsert_replies(reply_queue: DataFrame, accepted: DataFrame, as_of, first_id: int) -> DataFrame:
    """One row per (channel, ref): the last accepted reply replaces the text and clears the sending."""
    folded = accepted.groupBy("channel", "ref").agg(
        F.max_by(F.struct("brand", "text", "by_whom"), "seq").alias("last"), F.min("seq").alias("first_seq")
    )
    batch = folded.select(
        "channel",
        "ref",
        "first_seq",
        F.col("last.brand").alias("new_brand"),
        F.col("last.text").alias("new_text"),
        filled(RECORDS["origin"], by=F.col("last.by_whom")).alias("new_origin"),
    )
    joined = merged(reply_queue, batch, ["channel", "ref"])
    changed = F.col("first_seq").isNotNull()

    def take(name: str, new: Column) -> Column:
        return F.when(changed, new).otherwise(F.col(name)).alias(name)

    return joined.select(
        F.coalesce("id", F.lit(first_id) + F.col("first_seq")).alias("id"),
        take("brand", F.col("new_brand")),
        "channel",
        "ref",
        take("text", F.col("new_text")),
        take("origin", F.col("new_origin")),
        take("created_at", instant(as_of)),
        take("sent_at", F.lit(None)),
        take("result", F.lit(None)),
    )


def cancel_replies(reply_queue: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove unsent rows by id. Also returns each cancel with ``done``: only the first of an id can be."""
    first = cancels.groupBy("target_id").agg(F.min("seq").alias("seq"))
    open_ids = reply_queue.filter(F.col("sent_at").isNull()).select(F.col("id").alias("target_id"))
    hit = first.join(open_ids, "target_id", "left_semi").withColumn("done", F.lit(True))
    kept = reply_queue.join(
        hit.select(F.col("target_id").alias("id")), "id", "left_anti"
    )
    outcome = cancels.join(hit, ["target_id", "seq"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return kept, outcome


# --- case states and pauses -------------------------------------------------


def set_states(
    case_state: DataFrame, actions: DataFrame, as_of, first_id: int, states=OPERATOR_STATES
) -> tuple[DataFrame, DataFrame]:
    """Set the state of every row of a (conversation, brand), or add a row where there is none.

    ``updated_at`` of existing rows stays. Returns (table, rejected).
    """
    checked = actions.withColumn("error", F.when(~F.col("value").isin(*states), "state"))
    accepted, rejected = split_valid(checked)
    folded = accepted.groupBy("conversation_id", "brand").agg(
        F.max_by("value", "seq").alias("_state"), F.min_by(F.struct("seq", "by_whom", "author"), "seq").alias("_first")
    )
    key = ["conversation_id", "brand"]
    updated = skew_join(case_state, folded, key, "left", spread=["id"])
    updated = updated.withColumn("state", F.when(F.col("_first").isNotNull(), F.col("_state")).otherwise(F.col("state")))
    known = case_state.join(folded.select(*key), key, "left_semi").select(*key).distinct()
    absent = folded.join(known, key, "left_anti")
    added = absent.select(
        (F.lit(first_id) + F.col("_first.seq")).alias("id"),
        "brand",
        "conversation_id",
        F.col("_first.author").alias("author"),
        F.col("_state").alias("state"),
        F.lit(None).cast("string").alias("given_email"),
        F.lit(None).cast("int").alias("attempts"),
        F.to_json(F.struct(F.lit("tela").alias("origem"), F.col("_first.by_whom").alias("por"))).alias("context"),
        F.lit(None).cast("timestamp").alias("paused_until"),
        F.lit(None).cast("string").alias("pause_reason"),
        instant(as_of).alias("updated_at"),
    )
    return updated.drop("_state", "_first").unionByName(added), rejected


def set_pauses(pauses: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Pause a conversation for at most two weeks; no or zero hours end the pause, of any brand.

    The last action of a conversation decides. The author kept is the newest one
    named since the last end of the pause, else that of the table.
    """
    ends = F.coalesce("hours", F.lit(0)) <= 0
    named = ~ends & F.col("author").isNotNull()
    folded = actions.groupBy("conversation_id").agg(
        F.max_by(F.struct("hours", "brand", "by_whom", ends.alias("ended")), "seq").alias("last"),
        F.max(F.when(ends, F.col("seq"))).alias("ended_seq"),
        F.max_by(F.when(named, F.struct("seq", "author")), F.when(named, F.col("seq"))).alias("named"),
    )
    old = pauses.withColumnRenamed("brand", "old_brand").withColumnRenamed("author", "old_author")
    joined = merged(old, folded, ["conversation_id"])
    changed = F.col("last").isNotNull()
    until = instant(as_of) + F.make_dt_interval(F.lit(0), F.least(F.col("last.hours"), F.lit(PAUSE_MAX_HOURS)))
    fresh = F.col("named").isNotNull() & (
        F.col("ended_seq").isNull() | (F.col("named.seq") > F.col("ended_seq"))
    )
    author = F.when(fresh, F.col("named.author")).when(F.col("ended_seq").isNull(), F.col("old_author"))
    reason = filled(RECORDS["pause"], by=F.col("last.by_whom"))
    kept = joined.filter(~changed | ~F.col("last.ended"))
    return kept.select(
        "conversation_id",
        F.when(changed, F.col("last.brand")).otherwise(F.col("old_brand")).alias("brand"),
        F.when(changed, author).otherwise(F.col("old_author")).alias("author"),
        F.when(changed, reason).otherwise(F.col("reason")).alias("reason"),
        F.when(changed, until).otherwise(F.col("paused_until")).alias("paused_until"),
    )


# --- appended records -------------------------------------------------------


def register_refunds(actions: DataFrame, as_of, first_id: int) -> tuple[DataFrame, DataFrame]:
    """New refund rows and the rejected actions (unknown source of the reason)."""
    checked = actions.withColumn("error", F.when(~F.col("reason_source").isin(*REASON_SOURCES), "reason_source"))
    accepted, rejected = split_valid(checked)
    signed = filled(RECORDS["refund"], by=F.col("by_whom"))
    rows = accepted.select(
        (F.lit(first_id) + F.col("seq")).alias("id"),
        "brand",
        "channel",
        "author",
        "author_id",
        F.lower(blank_to_null(F.col("email"))).alias("email"),
        "transactions",
        "total",
        "currency",
        blank_to_null(F.col("reason")).alias("reason"),
        "reason_source",
        instant(as_of).alias("requested_at"),
        F.when(F.col("guided"), instant(as_of)).alias("guided_at"),
        F.concat_ws(" | ", blank_to_null(F.col("note")), signed).alias("note"),
        instant(as_of).alias("created_at"),
    )
    return rows, rejected


def author_names(messages: DataFrame) -> DataFrame:
    """The largest non-empty name known for each author."""
    named = messages.filter(F.col("author") != "")
    return named.groupBy("author_id").agg(F.max("author").alias("known_name"))


def _outbound_record(rows: DataFrame, as_of, first_id: int) -> DataFrame:
    """Audit rows in the shape of ``messages``: brand, channel, author, author_id and text are given."""
    return rows.select(
        (F.lit(first_id) + F.col("seq")).alias("id"),
        "brand",
        "channel",
        F.col("author_id").alias("conversation_id"),
        "author",
        "author_id",
        F.lit(OUTBOUND).alias("direction"),
        "text",
        F.lit(None).cast("string").alias("text_pt"),
        F.lit("HUMANO").alias("category"),
        F.lit(None).cast("string").alias("message_id"),
        instant(as_of).alias("created_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("timestamp").alias("hidden_at"),
    )


def answered_outside(messages: DataFrame, actions: DataFrame, as_of, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Outbound rows for threads answered by hand elsewhere, so that the queue drops them."""
    checked = actions.withColumn("error", F.when(~F.col("channel").isin(*OUTSIDE_CHANNELS), "channel"))
    accepted, rejected = split_valid(checked)
    note = F.coalesce(F.concat(F.lit(" "), blank_to_null(F.col("note"))), F.lit(""))
    asked = messages.join(accepted.select("author_id").distinct(), "author_id", "left_semi")
    named = skew_join(accepted, author_names(asked), ["author_id"], "left", spread=["seq"])
    text = filled(RECORDS["outside"], by=F.col("by_whom"), note=note)
    rows = named.withColumns({"author": F.col("known_name"), "text": text})
    return _outbound_record(rows, as_of, first_id), rejected


# --- comment moderation -----------------------------------------------------


def moderate_comments(
    messages: DataFrame, actions: DataFrame, as_of, first_id: int, brands, channels, fetch=None
) -> tuple[DataFrame, DataFrame]:
    """Delete, hide or show comments: (new messages with audit rows, outcome per action).

    ``kind`` is delete, hide or show. The first inbound row with the message id
    and brand is meant. A delete after a delete changes nothing; hiding or
    showing a deleted comment is a conflict. ``fetch`` gives the messages whose id is (``left_semi``) or is not (``left_anti``) in a frame; only those
    that change are joined with their change.
    """
    fetch = fetch or (lambda ids, how: messages.join(ids, "id", how))
    key = ["message_id", "brand"]
    actions = actions.withColumns({c: blank_to_null(F.col(c)) for c in (*key, "channel", "author_id")})
    inbound = messages.filter((F.col("direction") == INBOUND) & F.col("message_id").isNotNull())
    inbound = inbound.join(actions.select(*key).distinct(), key, "left_semi")
    inbound = inbound.withColumn("text", F.substring("text", 1, 120))
    targets = inbound.groupBy(*key).agg(F.min_by(F.struct("id", "deleted_at", "text"), "id").alias("_target"))
    # the first good delete of a comment closes it for the actions after it
    deletes = (
        actions.filter((F.col("kind") == "delete") & F.col("brand").isin(*brands) & F.col("channel").isin(*channels))
        .filter(F.col("author_id").isNotNull())
        .groupBy(*key)
        .agg(F.min("seq").alias("_deleted_seq"))
    )
    known = targets.join(deletes, key, "left")
    of_actions = messages.join(actions.select("author_id").distinct(), "author_id", "left_semi")
    named = skew_join(actions, author_names(of_actions), ["author_id"], "left", spread=["seq"])
    found = skew_join(named, known, key, "left", spread=["seq"], counted=actions)
    gone = F.col("_target.deleted_at").isNotNull() | (F.col("_deleted_seq") < F.col("seq"))
    missing = F.col("message_id").isNull() | F.col("brand").isNull() | F.col("channel").isNull()
    missing = missing | F.col("author_id").isNull()
    outcome = (
        F.when(missing, "missing_field")
        .when(~F.col("brand").isin(*brands), "brand")
        .when(~F.col("channel").isin(*channels), "channel")
        .when(F.col("_target").isNull(), "not_found")
        .when(gone & (F.col("kind") == "delete"), "already_deleted")
        .when(gone, "conflict")
        .otherwise("done")
    )
    judged = found.withColumn("outcome", outcome)
    done = judged.filter(F.col("outcome") == "done").withColumn("target_id", F.col("_target.id"))
    hiding = F.col("kind") != "delete"
    change = done.groupBy(F.col("target_id").alias("id")).agg(
        F.max(F.col("kind") == "delete").alias("_delete"),
        F.max_by(F.when(hiding, F.col("kind")), F.when(hiding, F.col("seq"))).alias("_visible"),
    )
    now = instant(as_of)
    updated = (
        fetch(change.select("id"), "left_semi").join(change, "id")
        .withColumn("deleted_at", F.when(F.coalesce("_delete", F.lit(False)), now).otherwise(F.col("deleted_at")))
        .withColumn(
            "hidden_at",
            F.when(F.col("_visible") == "hide", now).when(F.col("_visible").isNull(), F.col("hidden_at")),
        )
        .drop("_delete", "_visible")
    ).unionByName(fetch(change.select("id"), "left_anti"))
    start = F.coalesce("_target.text", F.lit(""))
    audit = F
    for kind in ("delete", "hide", "show"):
        audit = audit.when(F.col("kind") == kind, filled(RECORDS[kind], by=F.col("by_whom"), text=start))
    signed = done.withColumn("author", F.coalesce(blank_to_null(F.col("author")), F.col("known_name")))
    records = _outbound_record(signed.withColumn("text", audit), as_of, first_id)
    return updated.unionByName(records), judged.drop("_target", "_deleted_seq", "known_name")


# --- facts ------------------------------------------------------------------


def save_facts(facts: DataFrame, actions: DataFrame, as_of, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Add facts (no id) or change them (id); a blank topic keeps the old one. Returns (table, rejected)."""
    checked = (
        actions.withColumn("text", _text("text"))
        .withColumn("topic", blank_to_null(F.trim("topic")))
        .withColumn("error", F.when(F.col("text") == "", "empty"))
    )
    accepted, rejected = split_valid(checked)
    added = accepted.filter(F.col("target_id").isNull()).select(
        (F.lit(first_id) + F.col("seq")).alias("id"),
        F.coalesce("topic", F.lit(RECORDS["default_topic"])).alias("topic"),
        "text",
        F.lit(True).alias("active"),
        instant(as_of).alias("updated_at"),
        F.col("by_whom").alias("updated_by"),
    )
    has_topic = F.col("topic").isNotNull()
    changes = (
        accepted.filter(F.col("target_id").isNotNull())
        .groupBy(F.col("target_id").alias("id"))
        .agg(
            F.max_by("topic", F.when(has_topic, F.col("seq"))).alias("_topic"),
            F.max_by(F.struct("text", "by_whom"), "seq").alias("_last"),
        )
    )
    changed = F.col("_last").isNotNull()
    updated = facts.join(changes, "id", "left").select(
        "id",
        F.coalesce("_topic", "topic").alias("topic"),
        F.when(changed, F.col("_last.text")).otherwise(F.col("text")).alias("text"),
        "active",
        F.when(changed, instant(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(changed, F.col("_last.by_whom")).otherwise(F.col("updated_by")).alias("updated_by"),
    )
    return updated.unionByName(added), rejected


def delete_facts(facts: DataFrame, actions: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Switch facts off. Also returns each action with ``done``: true only if it did that."""
    first = actions.groupBy("target_id").agg(F.min_by(F.struct("seq", "by_whom"), "seq").alias("_first"))
    active = facts.filter("active").select(F.col("id").alias("target_id"))
    hit = first.join(active, "target_id", "left_semi")
    off = F.col("_first").isNotNull()
    updated = facts.join(hit.withColumnRenamed("target_id", "id"), "id", "left").select(
        "id",
        "topic",
        "text",
        F.when(off, False).otherwise(F.col("active")).alias("active"),
        F.when(off, instant(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(off, F.col("_first.by_whom")).otherwise(F.col("updated_by")).alias("updated_by"),
    )
    marks = hit.select("target_id", F.col("_first.seq").alias("seq"), F.lit(True).alias("done"))
    outcome = actions.join(marks, ["target_id", "seq"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return updated, outcome


# --- records of delivered, summarised, translated and suggested text ---------


def manual_approvals(decisions: DataFrame, as_of, channel: str = "links") -> DataFrame:
    """Audit rows of deliveries made without a paid purchase (``decisions`` of ``delivery.decide``)."""
    manual = decisions.filter(F.col("base") == "confirmacao_manual")
    return manual.select(
        "brand",
        F.col("author_id").alias("conversation_id"),
        F.lit(None).cast("string").alias("author"),
        F.coalesce("email", F.lit(RECORDS["no_email"])).alias("email_checked"),
        F.lit("tela").alias("origin"),
        F.lit("confianca_manual").alias("result"),
        F.lit(0).alias("n_found"),
        filled(RECORDS[channel], reason=trim_all(F.col("justification"))).alias("action_taken"),
        F.col("by_whom").alias("decided_by"),
        F.lit(True).alias("approved"),
        instant(as_of).alias("created_at"),
    )


def upsert_summaries(summaries: DataFrame, produced: DataFrame) -> DataFrame:
    """Replace or add the summary of an (author, brand); the last one by ``seq`` wins."""
    key = ["author_id", "brand"]
    last = newest(produced, key, "seq", []).drop("rank", "seq")
    return summaries.join(last.select(*key), key, "left_anti").unionByName(last)


def write_translations(messages: DataFrame, requested: DataFrame, translated: DataFrame) -> DataFrame:
    """Set ``text_pt`` of messages from the translations of their parts, in order, each after the white space that stood before its part.

    ``requested`` has the (id, part, lead) that were sent out, ``translated`` seq, id, part and pt. Of each part the last non-blank translation
    by ``seq`` counts; a message is written only when all of its parts came back.
    """
    none = F.lit(None)
    good = translated.withColumn("pt", trim_all(F.col("pt"))).filter((F.col("pt") != "") & F.col("part").isNotNull())
    good = good.select("id", "part", none.cast("struct<lead: string>").alias("lead"), "seq", "pt")
    sent = requested.select("id", "part", F.struct("lead").alias("lead"), none.cast("long").alias("seq"), none.cast("string").alias("pt"))
    # what was sent and what came back meet by id, so that texts are shuffled once
    parts = sent.unionByName(good).repartition("id").groupBy("id", "part").agg(
        F.collect_set("lead").alias("leads"), F.max_by("pt", F.when(F.col("pt").isNotNull(), F.col("seq"))).alias("pt")
    )
    pieces = F.transform("leads", lambda x: F.struct("part", F.concat(x["lead"], F.col("pt")).alias("pt")))
    whole = parts.filter(F.size("leads") > 0).groupBy("id").agg(
        F.count(F.when(F.col("pt").isNull(), 1)).alias("_missing"), F.sort_array(F.flatten(F.collect_list(pieces))).alias("_parts")
    )
    whole = whole.filter("_missing = 0").select("id", F.array_join("_parts.pt", "").alias("_pt"))
    return messages.join(whole, "id", "left").withColumn("text_pt", F.coalesce("_pt", "text_pt")).drop("_pt")


def log_suggestions(produced: DataFrame, as_of) -> DataFrame:
    """Suggestion log rows; input tokens are plain, cache-read and cache-written ones."""
    none = F.lit(0)
    tokens_in = (
        F.coalesce("input_tokens", none) + F.coalesce("cache_read", none) + F.coalesce("cache_creation", none)
    )
    return produced.select(
        "author_id",
        "brand",
        "channel",
        "lang",
        "mode",
        "instruction",
        "draft",
        "suggestion",
        "suggestion_pt",
        "model",
        tokens_in.alias("tokens_in"),
        F.coalesce("output_tokens", none).alias("tokens_out"),
        "by_whom",
        instant(as_of).alias("created_at"),
    )


def log_corrections(produced: DataFrame, messages: DataFrame, as_of, first_id: int, sample: int = 30) -> DataFrame:
    """A correction per improved draft; its question is the newest inbound text among the last messages."""
    improved = produced.filter((F.col("mode") == "melhorar") & (F.col("suggestion") != ""))
    said = messages.select("author_id", "id", "created_at", "direction", "text")
    said = said.join(improved.select("author_id").distinct(), "author_id", "left_semi")
    last = newest_rows(said, ["author_id"], "created_at", "id", sample)
    asked = last.filter((F.col("direction") == INBOUND) & (trim_all(F.coalesce("text", F.lit(""))) != ""))
    questions = asked.groupBy("author_id").agg(F.min_by("text", "rank").alias("question"))
    joined = skew_join(improved, questions, ["author_id"], "left", spread=["seq"])
    return joined.select(
        (F.lit(first_id) + F.col("seq")).alias("id"),
        "brand",
        "channel",
        F.lit(None).cast("string").alias("author"),
        "lang",
        F.col("categories").alias("category"),
        "question",
        F.coalesce("draft", F.lit("")).alias("before"),
        "instruction",
        F.col("suggestion").alias("after"),
        instant(as_of).alias("created_at"),
    )
