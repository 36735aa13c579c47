"""Text for whoever answers: transcripts, file lines, corrections, backlogs, parsed model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.constants import (
    CASE_IMPROVE,
    CASE_LAST,
    CASE_NO_LAST,
    CASE_TALK,
    CASE_TARGET,
    CASE_TEXT,
    CASE_WRITE,
    CHANNEL_TEXTS,
    CORRECTIONS_KEPT,
    CORRECTIONS_READ,
    INBOUND,
    LINES,
    NO_CORRECTIONS,
    NO_FACTS,
    PRIVATE_TEXT,
    REPLY_LANGS,
    SUMMARY_CASE,
    SUMMARY_LINES,
    TRANSCRIPT_LONG,
    TRANSCRIPT_SHORT,
    TRANSLATION_BATCH,
    TRANSLATION_CHARS,
    WORDS,
)
from inboxlake.functions.language import brand_language
from inboxlake.functions.text import blank_to_null, by_value, filled, is_blank, json_object_in, mask_email, stamp, trim_all
from inboxlake.operators.skew import newest_rows

DAY = "yyyy-MM-dd"


def _opt(prefix: str, c: Column) -> Column:
    """The prefix and the value, or nothing when the value is NULL or empty."""
    return F.coalesce(F.concat(F.lit(prefix), blank_to_null(c)), F.lit(""))


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def target_language(lang: Column, brand: Column) -> Column:
    """The language asked for, else the one in which the brand replies."""
    return F.coalesce(blank_to_null(lang), brand_language(brand, REPLY_LANGS))


# --- transcripts ------------------------------------------------------------


def _said(m) -> Column:
    return blank_to_null(trim_all(F.coalesce(m["text"], F.lit(""))))


def reply_line(m) -> Column:
    """A message as the one who answers sees it."""
    inbound = m["direction"] == INBOUND
    return filled(
        LINES["reply_message"],
        at=_shown(stamp(m["created_at"], "yyyy-MM-dd HH:mm")),
        channel=_shown(m["channel"]),
        category=_opt(" · ", m["category"]),
        who=F.when(inbound, WORDS["customer"]).otherwise(WORDS["us"]),
        text=F.coalesce(_said(m), F.when(inbound, WORDS["media_unknown"]).otherwise(WORDS["empty"])),
    )


def summary_line(m) -> Column:
    """A message as the summary sees it: internal notes and removed comments are told apart."""
    note = F.startswith(F.coalesce(m["text"], F.lit("")), F.lit("["))
    return filled(
        LINES["summary_message"],
        at=_shown(stamp(m["created_at"], "MM-dd HH:mm")),
        channel=_shown(m["channel"]),
        category=_opt(" ", m["category"]),
        who=F.when(m["direction"] == INBOUND, WORDS["customer"]).when(note, WORDS["internal"]).otherwise(WORDS["us"]),
        text=F.coalesce(_said(m), F.lit(WORDS["media"])),
        removed=F.when(m["deleted_at"].isNotNull(), WORDS["deleted"])
        .when(m["hidden_at"].isNotNull(), WORDS["hidden"])
        .otherwise(""),
    )


def transcript(messages: DataFrame, line=reply_line, k: int = TRANSCRIPT_SHORT, fetch=None) -> DataFrame:
    """The newest ``k`` messages of each author as one text, oldest first. ``fetch`` may look messages up by id, see ``newest_rows``."""
    columns = ["author_id", "id", "created_at", "direction", "channel", "category", "text", "deleted_at", "hidden_at"]
    known = messages.filter(F.col("author_id").isNotNull()).select(*columns)
    picked = newest_rows(known, ["author_id"], "created_at", "id", k, fetch=fetch)
    lines = picked.select("author_id", "rank", "created_at", line(F.struct(*columns)).alias("line"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("rank", "line"))))
    grouped = lines.groupBy("author_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_msgs"), F.max("created_at").alias("newest_at"), ordered.alias("_lines")
    )
    return grouped.withColumn("transcript", F.array_join(F.col("_lines.line"), "\n")).drop("_lines")


def summary_transcript(messages: DataFrame, fetch=None) -> DataFrame:
    return transcript(messages, summary_line, TRANSCRIPT_LONG, fetch)


# --- lines of the file ------------------------------------------------------


def amount_text(amount: Column) -> Column:
    """A two-decimal amount without trailing zeros."""
    return F.regexp_replace(amount.cast("string"), r"\.00$|(\.\d)0$", "$1")


def purchase_line(p) -> Column:
    return filled(
        LINES["purchase"],
        status=F.when(p["paid"], WORDS["paid"]).otherwise(_shown(p["status"])),
        product=_shown(p["product_name"]),
        amount=_shown(amount_text(p["amount"])),
        currency=_shown(p["currency"]),
        transaction=_shown(p["transaction"]),
        day=_shown(stamp(F.coalesce(p["approved_at"], p["registered_at"]), DAY)),
        email=mask_email(p["email"]),
        payment=_opt(" · ", p["payment"]),
    )


def item_line(i) -> Column:
    used = F.coalesce(filled(LINES["used"], day=stamp(i["downloaded_at"], DAY)), F.lit(WORDS["never_used"]))
    return filled(LINES["item"], title=_shown(i["title"]), brand=_shown(i["brand"]), used=used)


def refund_line(r) -> Column:
    return filled(
        LINES["refund"],
        day=_shown(stamp(r["requested_at"], DAY)),
        transactions=F.array_join(F.coalesce(r["transactions"], F.array().cast("array<string>")), ", "),
        reason=F.coalesce(r["reason"], F.lit("?")),
        guided=F.when(r["guided_at"].isNotNull(), WORDS["guided"]).otherwise(WORDS["not_guided"]),
    )


def state_line(s) -> Column:
    given = blank_to_null(s["given_email"])
    mail = F.when(given.isNull(), "").otherwise(filled(LINES["state_email"], email=mask_email(given)))
    line = filled(LINES["state"], state=_shown(s["state"]), email=mail, attempts=_shown(s["attempts"]))
    return F.when(s.isNull(), WORDS["never_entered"]).otherwise(line)


def pause_line(p) -> Column:
    until = _shown(stamp(p["paused_until"], "yyyy-MM-dd'T'HH:mm"))
    line = filled(LINES["pause"], until=until, reason=_shown(p["reason"]))
    return F.when(p.isNull(), WORDS["not_paused"]).otherwise(line)


def is_delivered(d) -> Column:
    """A delivery counts as delivered when it went well or has no result."""
    return is_blank(d["result"]) | (d["result"] == "ok")


def delivery_line(d, owner: str) -> Column:
    files = F.coalesce(d["files"], F.array().cast("array<string>"))
    n = F.size(files)
    first = F.array_join(F.slice(files, 1, 3), ", ")
    listed = F.when(n <= 3, first).otherwise(filled(LINES["more_files"], first=first, n=(n - 3).cast("string")))
    failed = filled(LINES["failed"], result=F.coalesce(d["result"], F.lit("?")))
    return filled(
        LINES["delivery"],
        day=F.coalesce(stamp(d["created_at"], "dd/MM/yyyy"), F.lit("")),
        to=mask_email(d["to_address"]),
        n=n.cast("string"),
        files=F.coalesce(blank_to_null(listed), F.lit("?")),
        result=F.when(d["result"] == "ok", WORDS["delivered"]).otherwise(failed),
        by=F.when(d["by_whom"] == "bot", WORDS["by_bot"]).otherwise(WORDS["by_owner"].format(owner=owner)),
    )


def lines(rows: DataFrame, build) -> DataFrame:
    """``build`` applied to each row of a section."""
    return rows.withColumn("line", build(F.struct(*rows.columns)))


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    """Per request: deliveries, those that went well, and the newest of these."""
    d = F.struct(*deliveries.columns)
    good = is_delivered(d)
    last = F.max_by(F.when(good, F.struct("created_at", "to_address")), F.when(good, F.struct("created_at", -F.col("id"))))
    grouped = deliveries.groupBy("request_key").agg(
        F.count(F.lit(1)).alias("n_deliveries"), F.count_if(good).alias("n_delivered"), last.alias("_last")
    )
    return grouped.select(
        "request_key",
        "n_deliveries",
        "n_delivered",
        F.col("_last.created_at").alias("last_at"),
        mask_email(F.col("_last.to_address")).alias("last_to"),
    )


# --- corrections and facts --------------------------------------------------


def _newest_corrections(corrections: DataFrame, read: int) -> DataFrame:
    """One row: the newest ``read`` corrections, newest first, as ``_top``."""
    order = [F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    top = corrections.orderBy(*order).limit(read).select(
        "created_at", "id", "lang", "channel", "instruction", "is_rule", "rule",
        F.substring("before", 1, 220).alias("before"), F.substring("after", 1, 220).alias("after"),
    )
    entry = F.struct("lang", "channel", "id", "instruction", "is_rule", "rule", "before", "after")
    order_key = F.struct(F.coalesce(-F.unix_micros("created_at"), F.lit(-(2**62))).alias("t"), (-F.col("id")).alias("i"))
    sorted_list = F.array_sort(F.collect_list(F.struct(order_key.alias("k"), entry.alias("e"))))
    return top.agg(F.transform(sorted_list, lambda x: x["e"]).alias("_top"))


def _by_kind(top: DataFrame, kept: int, shown=lambda ranked: ranked) -> Column:
    """A scalar with the languages and channels that the corrections of ``top`` name and, for each of these and for none (place 0), what ``shown`` makes of
    the ranked corrections with their ``line``: (corrections + 1) squared lists at most, whatever the tables hold."""

    def named(field):
        return F.array_distinct(F.filter(F.col("_top")[field], lambda x: x.isNotNull()))

    def ranked(lang, channel):
        matches = lambda c: F.coalesce((c["lang"] == lang) | (c["channel"] == channel), F.lit(False))
        both = F.concat(F.filter("_top", matches), F.filter("_top", lambda c: ~matches(c)))
        return shown(F.transform(F.slice(both, 1, kept), lambda c: c.withField("line", correction_line(c))))

    none = F.array(F.lit(None).cast("string"))
    lists = F.transform(F.concat(none, named("lang")), lambda l: F.transform(F.concat(none, named("channel")), lambda c: ranked(l, c)))
    return top.select(F.struct(named("lang").alias("langs"), named("channel").alias("channels"), lists.alias("lists")).alias("kinds")).scalar()


def _of_kind(requests: DataFrame, kinds: Column, name: str) -> DataFrame:
    """Add the list of the request's kind as ``name``."""
    place = lambda names, value: F.coalesce(F.array_position(names, value), F.lit(0)).cast("int")
    lang = place(F.col("_kinds.langs"), target_language(F.col("lang"), F.col("brand")))
    found = F.get(F.get(F.col("_kinds.lists"), lang), place(F.col("_kinds.channels"), F.col("channel")))
    return requests.withColumn("_kinds", kinds).withColumn(name, found).drop("_kinds")


def ranked_corrections(
    requests: DataFrame, corrections: DataFrame, read: int = CORRECTIONS_READ, kept: int = CORRECTIONS_KEPT
) -> DataFrame:
    """Add ``corrections`` to each request: of the newest ``read`` those of its language or channel
    first, newest first within both parts, ``kept`` in all, each with its ``line``.

    A request without a language has that of its brand. Only its language and channel decide the order, so lists are made once for each
    of these that the newest corrections name, in one scalar subquery: requests are neither joined nor shuffled nor ranked one by one.
    """
    return _of_kind(requests, _by_kind(_newest_corrections(corrections, read), kept), "corrections")


def correction_line(c) -> Column:
    both = ~is_blank(c["before"]) & ~is_blank(c["after"])
    return filled(
        LINES["correction"],
        rule_mark=F.when(F.coalesce(c["is_rule"], F.lit(False)), LINES["rule_mark"]).otherwise(""),
        asked=F.coalesce(filled(LINES["asked"], instruction=blank_to_null(c["instruction"])), F.lit("")),
        rule=F.coalesce(filled(LINES["rule"], rule=blank_to_null(c["rule"])), F.lit("")),
        pair=F.when(both, filled(LINES["pair"], before=c["before"], after=c["after"])).otherwise(""),
    )


def active_facts(facts: DataFrame) -> DataFrame:
    """Active facts by topic, each as a line."""
    line = filled(LINES["fact"], topic=F.col("topic"), text=F.col("text")).alias("line")
    return facts.filter("active").select("id", "topic", line).orderBy("topic", "id")


def reply_background(requests: DataFrame, corrections: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``knowledge`` (every active fact) and ``preferences`` (the ranked corrections) to each request, as texts.

    Both are scalar subqueries, as all requests share the facts and those of one kind the preferences: requests are neither joined nor shuffled.
    """
    entry = F.struct("topic", "id", filled(LINES["fact"], topic=_shown(F.col("topic")), text=_shown(F.col("text"))).alias("line"))
    joined = F.array_join(F.sort_array(F.collect_list(entry))["line"], "\n")
    lines = facts.filter("active").agg(F.coalesce(blank_to_null(joined), F.lit(NO_FACTS)).alias("text")).scalar()
    texts = lambda ranked: F.coalesce(blank_to_null(F.array_join(ranked["line"], "\n")), F.lit(NO_CORRECTIONS))
    kinds = _by_kind(_newest_corrections(corrections, CORRECTIONS_READ), CORRECTIONS_KEPT, texts)
    return _of_kind(requests, kinds, "preferences").withColumn("knowledge", lines)


# --- the case ---------------------------------------------------------------

def file_totals(keyed: DataFrame, bought: DataFrame, deliveries: DataFrame, counts: DataFrame) -> DataFrame:
    """Per request: purchases, paid ones, deliveries, those that went well, the newest of these, access counts."""
    purchases = bought.groupBy("request_key").agg(
        F.count(F.lit(1)).alias("n_purchases"), F.count_if("paid").alias("n_paid")
    )
    totals = keyed.join(purchases, "request_key", "left").join(delivery_summary(deliveries), "request_key", "left")
    return totals.join(counts, "request_key")


def case_context(
    requests: DataFrame, file: DataFrame, totals: DataFrame, transcripts: DataFrame, owner: str = "atendente"
) -> DataFrame:
    """The case text of each request: situation, file, conversation, and in ``melhorar`` mode the draft.

    ``requests`` has author_id, brand, channel, lang, mode, draft, instruction,
    categories, urgency_reason, window and target_comment; ``file`` is the
    customer file, one row per request; a missing language is that of the brand.
    """
    key = ["author_id", "brand"]
    asked = requests.select(
        *key, "channel", "lang", "mode", "draft", "instruction", "categories", "urgency_reason", "window", "target_comment"
    )
    heads = asked.join(totals, key).join(transcripts, "author_id", "left")
    used = ("state", "pause", "emails", "purchases", "items", "refunds", "deliveries")
    rows = file.select(*key, *used).join(heads, key)
    rows = rows.withColumn("lang", target_language(F.col("lang"), F.col("brand")))

    def block(name: str, build, none: str, joiner: str = "\n") -> Column:
        text = F.array_join(F.transform(name, build), joiner)
        return F.when(F.size(name) > 0, text).otherwise(F.lit(none))

    def n(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("0"))

    emails = blank_to_null(F.array_join(F.transform("emails", mask_email), ", "))
    last = filled(CASE_LAST, day=stamp(F.col("last_at"), "dd/MM/yyyy"), to=F.col("last_to"))
    target = filled(CASE_TARGET, target=blank_to_null(F.col("target_comment")))
    body = filled(
        CASE_TEXT,
        brand=F.col("brand"),
        channel=by_value(F.col("channel"), CHANNEL_TEXTS, F.lit(PRIVATE_TEXT)),
        lang=F.col("lang"),
        situation=F.coalesce("urgency_reason", F.lit("-")),
        window=_opt(" · ", F.col("window")),
        categories=F.coalesce("categories", F.lit("-")),
        target=F.coalesce(target, F.lit("")),
        emails=F.coalesce(emails, F.lit(WORDS["no_emails"])),
        n_paid=n("n_paid"),
        n_purchases=n("n_purchases"),
        purchases=block("purchases", purchase_line, WORDS["no_purchases"]),
        items=block("items", item_line, WORDS["no_items"]),
        n_delivered=n("n_delivered"),
        n_deliveries=n("n_deliveries"),
        deliveries=block("deliveries", lambda d: delivery_line(d, owner), WORDS["no_deliveries"]),
        last=F.coalesce(last, F.lit(CASE_NO_LAST)),
        n_logins=n("n_logins"),
        n_downloads=n("n_downloads"),
        state=state_line(F.col("state")),
        pause=pause_line(F.col("pause")),
        refunds=block("refunds", refund_line, WORDS["no_refunds"], " | "),
    )
    talk = filled(CASE_TALK, n=n("n_msgs"), transcript=F.coalesce("transcript", F.lit(WORDS["no_messages"])))
    improve = filled(
        CASE_IMPROVE,
        draft=F.coalesce("draft", F.lit(WORDS["no_draft"])),
        owner=F.lit(owner.upper()),
        instruction=F.coalesce("instruction", F.lit("")),
    )
    task = F.when(F.col("mode") == "melhorar", improve).otherwise(CASE_WRITE)
    return rows.select("author_id", "brand", "channel", "lang", "mode", F.concat(body, talk, task).alias("context"))


def summary_case(file: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The text that a summary is made from, for each file whose author has messages: purchases, deliveries, state, conversation.

    ``file`` is the customer file, ``transcripts`` are those of ``summary_transcript``.
    """
    words = SUMMARY_LINES

    def purchase(p):
        status = F.when(p["paid"], WORDS["paid"]).otherwise(_shown(p["status"]))
        day = _shown(stamp(F.coalesce(p["approved_at"], p["registered_at"]), DAY))
        return filled(words["purchase"], status=status, product=_shown(p["product_name"]), day=day, transaction=_shown(p["transaction"]))

    def delivery(d):
        n = F.greatest(F.coalesce(F.size(d["files"]), F.lit(0)), F.lit(0))
        at = _shown(stamp(d["created_at"], "yyyy-MM-dd HH:mm"))
        return filled(words["delivery"], at=at, to=_shown(d["to_address"]), n=n.cast("string"), result=_shown(d["result"]))

    def listed(name: str, line, none: str) -> Column:
        return F.coalesce(blank_to_null(F.array_join(F.transform(name, line), "; ")), F.lit(none))

    email = F.coalesce(filled(words["state_email"], email=blank_to_null(F.col("state.given_email"))), F.lit(""))
    state = F.when(F.col("state").isNull(), words["no_state"]).otherwise(F.concat(_shown(F.col("state.state")), email))
    text = filled(
        SUMMARY_CASE,
        brand=_shown(F.col("brand")),
        purchases=listed("purchases", purchase, words["no_purchases"]),
        deliveries=listed("deliveries", delivery, words["no_deliveries"]),
        state=state,
        n=F.col("n_msgs").cast("string"),
        transcript=F.col("transcript"),
    )
    return file.join(transcripts, "author_id").select("author_id", "brand", "n_msgs", "newest_at", text.alias("context"))


# --- backlogs ---------------------------------------------------------------


def translation_parts(text: Column, chars: int = TRANSLATION_CHARS) -> Column:
    """Parts of at most ``chars`` characters that spell a trimmed text, each with the white space before it (which does not count).

    A part ends where white space follows, as late as it can, and in the middle of a word only if that is longer than a part.
    """
    white = r"[\s\uFEFF]"
    return F.regexp_extract_all(text, F.lit(rf"(?sU){white}*+.{{0,{chars - 1}}}[^\s\uFEFF](?={white}|\z)|{white}*+.{{1,{chars}}}"), F.lit(0))


def translation_backlog(
    messages: DataFrame, requested: DataFrame | None = None, batch: int = TRANSLATION_BATCH, chars: int = TRANSLATION_CHARS
) -> DataFrame:
    """Requested messages (all by default): translated ones with their text, others in parts to be translated.

    A batch holds the ids of one range of ``batch`` ids, so it needs no ranking.
    A text longer than ``chars`` goes in several parts, cut at white space. ``lead`` is the white space that stood before a part: with it in front of
    each the parts are the trimmed text again, so nothing is lost or glued.
    """
    rows = messages.select("id", "text", "text_pt").filter(F.col("id") > 0)
    if requested is not None:
        rows = rows.join(requested.select("id").distinct(), "id", "left_semi")
    done = rows.filter(~is_blank(F.col("text_pt"))).select(
        "id", F.lit(True).alias("done"), F.lit(None).cast("long").alias("batch"), F.lit(0).alias("part"), F.lit("").alias("lead"),
        F.col("text_pt").alias("text"),
    )
    pending = rows.filter(is_blank(F.col("text_pt"))).select("id", trim_all(F.coalesce("text", F.lit(""))).alias("text"))
    parts = pending.filter("text <> ''").select("id", F.posexplode(translation_parts(F.col("text"), chars)).alias("part", "piece"))
    lead = F.regexp_extract("piece", r"(?U)^[\s\uFEFF]*", 0)
    todo = parts.select(
        "id", F.lit(False).alias("done"), F.floor(F.col("id") / batch).alias("batch"), "part", lead.alias("lead"),
        F.substring(F.col("piece"), F.length(lead) + 1, F.length("piece")).alias("text"),
    )
    return done.unionByName(todo)


def summary_backlog(requests: DataFrame, messages: DataFrame, summaries: DataFrame, k: int = TRANSCRIPT_LONG) -> DataFrame:
    """Requests (author_id, brand, force) with ``outcome``: ``no_messages``, ``cached`` or ``stale`` (none cached, forced, or newer messages).

    A request whose author never wrote stays, with no messages and nothing to make a summary of.
    """
    spoken = messages.groupBy("author_id").agg(
        F.max("created_at").alias("newest_at"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n_msgs")
    )
    asked = requests.select("author_id").distinct()
    rows = requests.join(spoken.join(asked, "author_id", "left_semi"), "author_id", "left").withColumn("n_msgs", F.coalesce("n_msgs", F.lit(0)))
    cached = summaries.select("author_id", "brand", "covers_until")
    rows = rows.join(cached, ["author_id", "brand"], "left")
    fresh = (F.col("covers_until") >= F.col("newest_at")) & ~F.coalesce("force", F.lit(False))
    stale = (F.col("n_msgs") > 0) & ~F.coalesce(fresh, F.lit(False))
    outcome = F.when(F.col("n_msgs") == 0, "no_messages").when(stale, "stale").otherwise("cached")
    return rows.withColumn("stale", stale).withColumn("outcome", outcome)


# --- model output -----------------------------------------------------------


def parsed_output(outputs: DataFrame, raw: str, fields: list[str], note: tuple[str, str] | None = None) -> DataFrame:
    """Fields of the JSON object inside free text, trimmed, '' when absent.

    When there is no valid object the whole text becomes the first field, and
    ``note`` (field, text) says so.
    """
    parsed = outputs.withColumn("_json", F.try_parse_json(json_object_in(F.col(raw))))
    valid = F.col("_json").isNotNull()
    for place, field in enumerate(fields):
        value = F.coalesce(F.try_variant_get("_json", f"$.{field}", "string"), F.lit(""))
        otherwise = F.lit("")
        if place == 0:
            otherwise = F.coalesce(raw, F.lit(""))
        elif note is not None and field == note[0]:
            otherwise = F.lit(note[1])
        parsed = parsed.withColumn(field, trim_all(F.when(valid, value).otherwise(otherwise)))
    return parsed.drop("_json")
