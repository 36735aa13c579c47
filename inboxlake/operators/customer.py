"""The customer file: e-mail identity, purchases, rights, accesses, refunds, queue.

``requests`` (author_id, brand or NULL for all brands) says for whom; every
section has one or more rows per request and carries its ``request_key``.

Joins here are of two kinds. Where both sides come straight from a shuffle the
join is a plain one: adaptive execution splits a hot key on either side. Where
one side is grouped or ranked by the join key first it cannot, and the shared
e-mail addresses are split by ``skew_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.constants import EMAIL_IN_TEXT, INBOUND, PAID_STATUSES, TOP_ACCESSES, TOP_QUEUE
from inboxlake.functions.text import instant
from inboxlake.operators.skew import newest, skew_join

ITEM = ["brand", "title", "bucket", "file", "product_id", "position"]


def customer_requests(requests: DataFrame) -> DataFrame:
    """Distinct requests with a key of their own: the author, then the brand if one is asked. A missing author is empty in it."""
    return requests.select("author_id", "brand").distinct().withColumn("request_key", request_key())


def request_key() -> Column:
    return F.concat_ws("|", F.coalesce("author_id", F.lit("")), "brand")


def _by_author(keyed: DataFrame, author: str = "author_id") -> DataFrame:
    return keyed.select(F.col("author_id").alias(author), "request_key")


def newest_state(keyed: DataFrame, case_state: DataFrame) -> DataFrame:
    """The newest case state of the conversation, in the asked brand if one is asked."""
    wanted = keyed.select(F.col("author_id").alias("conversation_id"), "request_key", F.col("brand").alias("_asked"))
    # one row per brand is enough: a conversation with very many states is reduced before the join
    rows = newest(case_state, ["conversation_id", "brand"], "updated_at", ["id"]).drop("rank")
    rows = rows.join(wanted, "conversation_id")
    rows = rows.filter(F.col("_asked").isNull() | (F.col("_asked") == F.col("brand"))).drop("_asked")
    return newest(rows, ["request_key"], "updated_at", ["id"]).drop("rank")


def emails_in_text(messages: DataFrame) -> DataFrame:
    """Every e-mail address written in an inbound text, as often as it is written."""
    found = F.regexp_extract_all("text", F.lit(EMAIL_IN_TEXT), F.lit(0))
    inbound = messages.filter((F.col("direction") == INBOUND) & F.contains("text", F.lit("@")))
    return inbound.select("author_id", F.explode(found).alias("email"))


def known_emails(keyed: DataFrame, states: DataFrame, refunds: DataFrame, messages: DataFrame) -> DataFrame:
    """(request, author, e-mail): from the newest state, from refunds and from inbound texts; lower case, not blank."""
    # authors that nobody asked for go in the join below, when there are no texts any more
    written = emails_in_text(messages).select("author_id", F.lower("email").alias("email"))
    refunded = refunds.filter(F.col("author_id").isNotNull()).select("author_id", F.lower("email").alias("email"))
    of_author = written.unionByName(refunded).distinct()
    of_request = of_author.join(_by_author(keyed), "author_id").select("request_key", "author_id", "email")
    author = F.col("conversation_id").alias("author_id")
    given = states.select("request_key", author, F.lower("given_email").alias("email"))
    return of_request.unionByName(given).filter(F.trim("email") != "").distinct()


def _by_email(emails: DataFrame) -> DataFrame:
    return emails.select("request_key", F.col("email").alias("email_key"))


def customer_purchases(emails: DataFrame, purchases: DataFrame) -> DataFrame:
    """Purchases under a known e-mail, with the paid flag, payment type and country."""
    raw = F.try_parse_json("raw")
    checkout = F.try_variant_get(raw, "$.data.purchase.checkout_country.iso", "string")
    address = F.try_variant_get(raw, "$.data.buyer.address.country_iso", "string")
    bought = purchases.select(
        F.lower("email").alias("email_key"),
        "transaction",
        "email",
        "name",
        "product_id",
        "product_name",
        "status",
        F.col("status").isin(*PAID_STATUSES).alias("paid"),
        "amount",
        "currency",
        F.timestamp_millis("approved_ms").alias("approved_at"),
        "registered_at",
        F.try_variant_get(raw, "$.data.purchase.payment.type", "string").alias("payment"),
        F.coalesce(checkout, address).alias("country"),
    )
    return bought.join(_by_email(emails), "email_key").drop("email_key")


def entitlements(bought: DataFrame, items: DataFrame) -> DataFrame:
    """Active items unlocked by a product that was paid for, each once per request."""
    paid = bought.filter(F.col("paid")).select("request_key", "product_id").distinct()
    unlocks = items.filter(F.col("active")).select(
        F.explode(F.array_distinct("unlocked_by")).alias("unlocking_id"), F.col("id").alias("item_id"), *ITEM
    )
    rights = paid.withColumnRenamed("product_id", "unlocking_id").join(unlocks, "unlocking_id")
    return rights.drop("unlocking_id").distinct()


def last_downloads(emails: DataFrame, accesses: DataFrame) -> DataFrame:
    """Newest download of each file under any known e-mail."""
    downloads = accesses.filter((F.col("event") == "download") & F.col("file").isNotNull())
    per_email = downloads.groupBy(F.lower("email").alias("email_key"), "file").agg(F.max("created_at").alias("at"))
    return per_email.join(_by_email(emails), "email_key").groupBy("request_key", "file").agg(F.max("at").alias("downloaded_at"))


def customer_items(bought: DataFrame, emails: DataFrame, items: DataFrame, accesses: DataFrame) -> DataFrame:
    """Entitled items with the time of their last download."""
    rights = entitlements(bought, items)
    return rights.join(last_downloads(emails, accesses), ["request_key", "file"], "left")


def customer_accesses(emails: DataFrame, accesses: DataFrame, k: int = TOP_ACCESSES) -> DataFrame:
    """The newest accesses under any known e-mail: first per e-mail, then per request."""
    tie = ["event", "file", "email"]
    keyed = accesses.withColumn("email_key", F.lower("email"))
    per_email = newest(keyed, ["email_key"], "created_at", tie, k).drop("rank")
    joined = skew_join(_by_email(emails), per_email, ["email_key"], spread=["request_key"])
    return newest(joined, ["request_key"], "created_at", tie, k).drop("email_key")


def access_counts(keyed: DataFrame, emails: DataFrame, accesses: DataFrame) -> DataFrame:
    """Logins and downloads per request, 0 when none; counted per e-mail before the join."""
    per_email = accesses.groupBy(F.lower("email").alias("email_key")).agg(
        F.count_if(F.col("event") == "login").alias("n_logins"),
        F.count_if(F.col("event") == "download").alias("n_downloads"),
    )
    joined = skew_join(_by_email(emails), per_email, ["email_key"], spread=["request_key"])
    counts = joined.groupBy("request_key").agg(
        F.sum("n_logins").alias("n_logins"), F.sum("n_downloads").alias("n_downloads")
    )
    return keyed.select("request_key").join(counts, "request_key", "left").fillna(0, ["n_logins", "n_downloads"])


def _by_author_or_email(keyed: DataFrame, emails: DataFrame, rows: DataFrame, email: str) -> DataFrame:
    """Rows that name the author, and rows under a known e-mail that do not: two disjoint equi joins."""
    named = rows.join(_by_author(keyed), "author_id")
    with_email = rows.withColumn("email_key", F.lower(email)).filter(F.col("email_key").isNotNull())
    wanted = emails.select("request_key", F.col("email").alias("email_key"), F.col("author_id").alias("_asked"))
    mailed = with_email.join(wanted, "email_key")
    mailed = mailed.filter(~F.col("author_id").eqNullSafe(F.col("_asked"))).drop("_asked", "email_key")
    return named.unionByName(mailed)


def customer_refunds(keyed: DataFrame, emails: DataFrame, refunds: DataFrame) -> DataFrame:
    return _by_author_or_email(keyed, emails, refunds, "email")


def customer_deliveries(keyed: DataFrame, emails: DataFrame, deliveries: DataFrame) -> DataFrame:
    return _by_author_or_email(keyed, emails, deliveries, "to_address")


def customer_checks(keyed: DataFrame, purchase_checks: DataFrame) -> DataFrame:
    """Purchase checks of the conversation, without the raw answer."""
    checks = purchase_checks.drop("api_response")
    return checks.join(_by_author(keyed, "conversation_id"), "conversation_id")


def reply_refs(keyed: DataFrame, messages: DataFrame) -> DataFrame:
    """(request, ref): the author and every message id of the author."""
    own = messages.filter(F.col("message_id").isNotNull()).select("author_id", F.col("message_id").alias("ref"))
    of_messages = own.join(_by_author(keyed), "author_id").select("request_key", "ref")
    return of_messages.unionByName(keyed.select("request_key", F.col("author_id").alias("ref"))).distinct()


def customer_queue(refs: DataFrame, reply_queue: DataFrame, k: int = TOP_QUEUE) -> DataFrame:
    """The newest queue rows of the customer. (channel, ref) is unique, so a ref has few rows."""
    return newest(reply_queue.join(refs, "ref"), ["request_key"], "created_at", ["id"], k)


def customer_pending(refs: DataFrame, pending_replies: DataFrame) -> DataFrame:
    return pending_replies.join(refs, "ref")


def customer_pause(keyed: DataFrame, pauses: DataFrame) -> DataFrame:
    return pauses.join(_by_author(keyed, "conversation_id"), "conversation_id")


# --- the file -------------------------------------------------------------


def _descending(time: Column) -> Column:
    """A string that rises as the time falls; 18 digits cover every timestamp up to the year 5138."""
    return F.lpad((F.lit(10**17) - F.unix_micros(time)).cast("string"), 18, "0")


def sort_number(c: Column) -> Column:
    """A string that sorts as the whole number does, negative ones too; missing ones last."""
    shifted = c.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit("~"))


def sort_text(*parts: Column) -> Column:
    """Parts as one string that sorts as they do; the separator is below every printable character."""
    return F.concat_ws("\u0001", *parts)


def _order(time: Column, nulls_first: bool = True) -> Column:
    return F.coalesce(_descending(time), F.lit("" if nulls_first else "~"))


def _section(df: DataFrame, name: str, order: list[Column], drop: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    columns = [c for c in df.columns if c not in ("request_key", "rank", *drop) and (only is None or c in only)]
    return df.select(
        "request_key",
        F.lit(name).alias("section"),
        sort_text(*order).alias("order"),
        F.struct(*columns).alias(name),
    )


def sections(
    keyed: DataFrame,
    states: DataFrame,
    emails: DataFrame,
    bought: DataFrame,
    refs: DataFrame,
    reply_queue: DataFrame,
    pauses: DataFrame,
    items: DataFrame,
    accesses: DataFrame,
    refunds: DataFrame,
    purchase_checks: DataFrame,
    pending_replies: DataFrame,
    deliveries: DataFrame,
) -> dict[str, DataFrame]:
    """Every section of the file as flat rows, by name.

    ``states``, ``emails``, ``bought`` and ``refs`` are the steps above. Several
    sections need the e-mails and purchases: write them once (``tables.settled``).
    """
    return {
        "state": states,
        "pause": customer_pause(keyed, pauses),
        "emails": emails,
        "purchases": bought,
        "items": customer_items(bought, emails, items, accesses),
        "accesses": customer_accesses(emails, accesses),
        "refunds": customer_refunds(keyed, emails, refunds),
        "checks": customer_checks(keyed, purchase_checks),
        "queue": customer_queue(refs, reply_queue),
        "pending": customer_pending(refs, pending_replies),
        "deliveries": customer_deliveries(keyed, emails, deliveries),
        "counts": access_counts(keyed, emails, accesses),
    }


def customer_file(keyed: DataFrame, parts: dict[str, DataFrame], as_of, shown: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One nested row per request, with an array per section, empty when there is nothing.

    ``parts`` may hold some of the sections only; the file then has these alone, and nothing is read for the others. ``shown`` names the columns that the
    entries of a section have, all by default; others are neither read nor shuffled, but those that a section goes by still order it.
    The sections are stacked and grouped once instead of joined one by one. A file is one row however long it is; whoever
    has customers too large for a row works on the flat rows of ``sections``, which are the same entries.
    """
    at, tie = F.col, [sort_number(F.col("id"))]
    last = lambda c: F.coalesce(c, F.lit("~"))
    orders = {
        "state": [F.lit("")],
        "pause": [F.lit("")],
        "counts": [F.lit("")],
        "emails": [at("email")],
        "purchases": [_order(at("approved_at"), False), _order(at("registered_at")), last(at("transaction"))],
        "items": [last(at("brand")), sort_number(at("position")), sort_number(at("item_id"))],
        "accesses": [sort_number(at("rank"))],
        "refunds": [_order(at("created_at")), *tie],
        "checks": [_order(at("created_at")), last(at("email_checked"))],
        "queue": [_order(at("created_at")), *tie],
        "pending": [_order(at("created_at")), last(at("ref")), last(at("text"))],
        "deliveries": [_order(at("created_at")), *tie],
    }
    dropped = {"emails": ("author_id",)}
    stacked = [_section(parts[n], n, order, dropped.get(n, ()), (shown or {}).get(n)) for n, order in orders.items() if n in parts]
    # the request itself, so that one without any entry has a row too
    rows = keyed.select("request_key", "author_id", "brand", F.lit("").alias("section"), F.lit("").alias("order"))
    for frame in stacked:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    single = [n for n in ("state", "pause", "counts") if n in parts]
    listed = [n for n in orders if n in parts and n not in single]
    files = rows.groupBy("request_key").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in ("author_id", "brand", *single)],
        *[F.sort_array(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("order", n)))).alias(n) for n in listed],
    )
    return files.select(
        instant(as_of).alias("as_of"),
        "author_id",
        "brand",
        *[n for n in single if n != "counts"],
        *[(F.col("emails.emails.email") if n == "emails" else F.col(n)[n]).alias(n) for n in listed],
        *(["counts.n_logins", "counts.n_downloads"] if "counts" in parts else []),
    )
