"""Which files a customer may get, their links, and the message that carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.constants import BRAND_LANGS, BRAND_NAMES, EMAIL_SHAPE, MAIL_TEXTS
from inboxlake.functions.language import brand_language
from inboxlake.functions.text import by_value, escape_html, first_name, instant, public_url, trim_all
from inboxlake.operators.skew import spread_pairs, with_place

ITEM = ["brand", "title", "bucket", "file", "position"]


def paid_purchases(purchases: DataFrame) -> DataFrame:
    return purchases.filter(F.col("paid"))


def manual_items(items: DataFrame) -> DataFrame:
    """What a manual approval releases: the active main items of a brand."""
    return items.filter(F.col("active") & (F.col("section") == "principal")).select(F.col("id").alias("item_id"), *ITEM)


def requested_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Active items of the request's brand that are, or are unlocked by, a product on its list."""
    asked = requests.select("request_key", "brand", F.explode("products").alias("product")).filter(F.col("product") > 0)
    active = items.filter("active")
    products = F.array_distinct(F.concat(F.array("product_id"), F.coalesce("unlocked_by", F.array().cast("array<bigint>"))))
    offered = active.select(F.explode(products).alias("product"), F.col("id").alias("item_id"), *ITEM)
    return asked.distinct().join(offered, ["brand", "product"]).drop("product").distinct()


def has_products(products: Column) -> Column:
    return F.exists(F.coalesce(products, F.array().cast("array<bigint>")), lambda p: p > 0)


def decide(requests: DataFrame, purchases: DataFrame) -> DataFrame:
    """Add ``base``: ``compra`` with a product list or a paid purchase, ``confirmacao_manual`` with a
    confirmation and its reason, else NULL: the request needs a confirmation."""
    paid = purchases.filter(F.col("paid")).select("request_key").distinct().withColumn("has_paid", F.lit(True))
    joined = requests.join(paid, "request_key", "left").withColumn("has_paid", F.coalesce("has_paid", F.lit(False)))
    listed = has_products(F.col("products"))
    reason = trim_all(F.coalesce("justification", F.lit("")))
    confirmed = F.coalesce("confirm", F.lit(False)) & (reason != "")
    # a list, even one without a usable product, takes the place of the purchases
    no_list = F.coalesce(F.size("products"), F.lit(0)) <= 0
    base = F.when(listed | (no_list & F.col("has_paid")), "compra").when(confirmed, "confirmacao_manual")
    return joined.withColumn("base", base).withColumn("listed", listed)


def deliverable_items(
    decisions: DataFrame, rights: DataFrame, items: DataFrame, folder: str | None = None, only_chosen: bool = False
) -> DataFrame:
    """The items of each decided request in order, ``place`` from 0.

    From the product list, from the entitlements (these are chosen by place), or
    the main items of the brand, which are put in order once for all requests. All pairs of these are dealt to many tasks; with ``only_chosen`` those
    that a request does not name in its ``item_ids`` are not made, for ``chosen_items``, which applies to the rest.
    """
    by_list = requested_items(decisions.filter("listed"), items).withColumn("key_id", F.col("item_id"))
    bought = decisions.filter(~F.col("listed") & (F.col("base") == "compra")).select("request_key")
    by_right = rights.select("request_key", "item_id", *ITEM).join(bought, "request_key", "left_semi")
    by_right = by_right.withColumn("key_id", F.lit(None).cast("long"))
    manual = decisions.filter(F.col("base") == "confirmacao_manual")
    main = with_place(manual_items(items), ["brand"], ["position"], "item_id").drop("position")
    whole = manual.filter(_names_none()) if only_chosen else manual
    by_hand = spread_pairs(whole.select("request_key", "brand"), main, ["brand"], "request_key", "item_id")
    if only_chosen:
        named = manual.filter(~_names_none()).select("request_key", "brand", F.explode(F.array_distinct("item_ids")).alias("item_id"))
        by_hand = by_hand.unionByName(named.join(main, ["brand", "item_id"]))
    placed = with_place(by_list.unionByName(by_right), ["request_key"], ["brand", "position"], "item_id", folder=folder).drop("position")
    return placed.unionByName(by_hand.withColumn("key_id", F.col("item_id")))


def _names_none() -> Column:
    return F.coalesce(F.size("item_ids"), F.lit(0)) <= 0


def chosen_items(placed: DataFrame, requests: DataFrame) -> DataFrame:
    """Only the items a request names, by id, or by place where the item came without one."""
    wanted = requests.select("request_key", "item_ids")
    joined = placed.join(wanted, "request_key")
    return joined.filter(_names_none() | F.array_contains("item_ids", F.coalesce("key_id", "place"))).drop("item_ids")


def with_links(placed: DataFrame, base_url: str, public_buckets: list[str]) -> DataFrame:
    """Permanent links of files in public buckets; NULL where the storage service must sign one."""
    url = public_url(F.lit(base_url), F.col("bucket"), F.col("file"))
    return placed.withColumn("url", F.when(F.col("bucket").isin(*public_buckets), url))


def with_address(requests: DataFrame) -> DataFrame:
    """Trimmed lower-case address, and whether it looks like one."""
    address = F.lower(trim_all(F.col("to_address")))
    return requests.withColumn("to_address", address).withColumn("valid_address", address.rlike(EMAIL_SHAPE))


def message_language(asked: Column, brand: Column, brand_langs=BRAND_LANGS) -> Column:
    """The asked language if there are texts for it, else that of the brand."""
    return F.when(asked.isin(*MAIL_TEXTS), asked).otherwise(brand_language(brand, brand_langs))


def addressee(requests: DataFrame, purchases: DataFrame) -> DataFrame:
    """First name: the one given with the request, else that of the newest paid purchase.

    A request with a product list, even an unusable one, is answered without looking at purchases, so it has only its own.
    """
    paid = purchases.filter(F.col("paid"))
    order = F.struct(
        F.coalesce(F.unix_micros("approved_at"), F.lit(-(2**62))), F.unix_micros("registered_at"), "transaction"
    )
    named = paid.groupBy("request_key").agg(F.max_by("name", order).alias("_buyer"))
    joined = requests.join(named, "request_key", "left")
    return joined.withColumn("first_name", first_name(F.coalesce("name", F.when(F.coalesce(F.size("products"), F.lit(0)) <= 0, F.col("_buyer"))))).drop("_buyer")


def mail_text(lang: Column, part: str) -> Column:
    values = {name: texts[part] for name, texts in MAIL_TEXTS.items()}
    return by_value(lang, values, F.lit(None).cast("string"))


def rendered(requests: DataFrame, linked: DataFrame, brand_names=BRAND_NAMES) -> DataFrame:
    """Subject, plain text and HTML of the message of each request with links.

    ``requests`` has brand, lang (see ``message_language``), first_name and
    message. All links of a request are in its one message.
    """
    usable = linked.filter(F.col("url").isNotNull())
    entry = F.struct("place", "title", "url")
    grouped = usable.groupBy("request_key").agg(F.array_sort(F.collect_list(entry)).alias("_links"))
    rows = requests.join(grouped, "request_key")
    lang, name = F.col("lang"), F.col("first_name")
    brand = F.coalesce(by_value(F.col("brand"), brand_names, F.col("brand")), F.lit(""))
    extra = trim_all(F.coalesce("message", F.lit("")))
    greeting = F.when(name != "", F.concat(F.lit(" "), name)).otherwise(F.lit(""))
    subject = F.replace(mail_text(lang, "subject"), F.lit("{marca}"), brand)
    plain_links = F.array_join(F.transform("_links", lambda l: F.concat(l["title"], F.lit(": "), l["url"])), "\n")
    plain = F.concat(
        mail_text(lang, "hello"), greeting, F.lit("\n\n"), mail_text(lang, "intro"), F.lit("\n"),
        F.when(extra != "", F.concat(F.lit("\n"), extra, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\n"), plain_links, F.lit("\n\n"), mail_text(lang, "note"), F.lit("\n"), mail_text(lang, "end"),
    )

    def paragraph(c: Column) -> Column:
        return F.concat(F.lit("<p>"), c, F.lit("</p>"))

    button = escape_html(mail_text(lang, "button"))
    html_links = F.array_join(
        F.transform(
            "_links",
            lambda l: F.concat(
                F.lit("<li>"), escape_html(l["title"]), F.lit(' <a href="'), escape_html(l["url"]), F.lit('">'), button,
                F.lit("</a></li>"),
            ),
        ),
        "",
    )
    html = F.concat(
        F.lit("<!doctype html><html><body><h2>"), escape_html(brand), F.lit("</h2>"),
        F.lit("<h1>"), escape_html(mail_text(lang, "hello")), escape_html(greeting), F.lit("</h1>"),
        paragraph(escape_html(mail_text(lang, "intro"))),
        F.when(extra != "", paragraph(F.replace(escape_html(extra), F.lit("\n"), F.lit("<br>")))).otherwise(F.lit("")),
        F.lit("<ul>"), html_links, F.lit("</ul>"),
        paragraph(escape_html(mail_text(lang, "note"))), paragraph(escape_html(mail_text(lang, "end"))),
        F.lit("</body></html>"),
    )
    return rows.select(
        "request_key", "author_id", "brand", "lang", subject.alias("subject"), plain.alias("plain"),
        html.alias("html"), F.col("_links.title").alias("files"),
    )


def delivery_records(mails: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """The rows that sent messages add to the deliveries, without the id that the table gives them.

    ``mails`` of ``rendered``; ``requests`` has request_key, to_address, base, by_whom and the service's ok, status and body.
    """
    sent = requests.select("request_key", "to_address", "base", "by_whom", send_result(F.col("ok"), F.col("status"), F.col("body")).alias("result"))
    return mails.join(sent, "request_key").select(
        "author_id", "brand", "lang", "to_address", "subject", "files", "base", "result", "by_whom", instant(as_of).alias("created_at")
    )


def send_result(ok: Column, status: Column, body: Column) -> Column:
    """``ok``, or the service's status and the start of its answer."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit("ok")).otherwise(
        F.concat(F.lit("resend "), status.cast("string"), F.lit(": "), F.substring(F.coalesce(body, F.lit("{}")), 1, 300))
    )
