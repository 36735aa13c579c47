"""Queries that decide, link and render deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlake.constants import BRAND_LANGS, BRAND_NAMES, DEFAULT_LANG, MAIL_TEXTS
from inboxlake.operators import customer, delivery as op
from inboxlake.plans.customer import ENTITLED, Parts
from inboxlake.plans.registry import NOW, query
from inboxlake.sources.derived import AS_OF
from inboxlake.sources.tables import workspace

BASE_URL = "https://files.example//"
PUBLIC = ["public files"]
TRIMMED = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"

# Parts of a trimmed text: as many characters as end before white space within 2,000, else 2,000; the white space before a part is its lead.
PARTS = rf"""
, recursive cuts as (
  select id, -1 as part, '' as lead, '' as text, {TRIMMED.format('text')} as rest from messages
  where coalesce(text_pt, '') = '' and {TRIMMED.format('text')} <> '' and id > 0
  union all
  select id, part + 1, lead, body[:size], body[size + 1:] from (
    select id, part, lead, body, case when length(body) <= 2000 then length(body)
      else coalesce(nullif(length(regexp_extract(body[:2001], '^([\s\S]*\S)\s', 1)), 0), 2000) end as size
    from (select id, part, regexp_extract(rest, '^\s*') as lead, regexp_replace(rest, '^\s+', '') as body from cuts where rest <> ''))
), parts as (select id, part, lead, text from cuts where part >= 0)"""


def _for_sends(sql: str) -> str:
    return sql.replace("from requests)", "from send_requests)")


def case_sql(key: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in values.items())
    return f"case {key} {whens} else {otherwise} end"


USABLE = "len(list_filter(coalesce(s.products, []), lambda x: x > 0)) > 0"

DECIDED = (
    _for_sends(ENTITLED)
    + f"""
, decided as (
  select concat_ws('|', coalesce(s.author_id, ''), s.brand) as request_key, s.*, {USABLE} as listed,
    case when {USABLE} then 'compra'
      when coalesce(len(s.products), 0) = 0 and concat_ws('|', coalesce(s.author_id, ''), s.brand) in (select request_key from paid_products) then 'compra'
      when coalesce(s.confirm, false) and {TRIMMED.format('s.justification')} <> '' then 'confirmacao_manual' end as base
  from send_requests s
)"""
)

PLACED = (
    DECIDED
    + """
, asked as (select distinct request_key, brand, product from (select request_key, brand, unnest(products) as product from decided where listed) where product > 0)
, picked as (
  select distinct a.request_key, i.id as item_id, i.id as key_id from asked a
  join items i on i.active and i.brand = a.brand and (i.product_id = a.product or list_contains(i.unlocked_by, a.product))
  union all
  select e.request_key, e.item_id, null from entitled e join decided d using (request_key) where d.base = 'compra' and not d.listed
  union all
  select d.request_key, i.id, i.id from decided d join items i on i.active and i.section = 'principal' and i.brand = d.brand
  where d.base = 'confirmacao_manual'
)
, placed as (
  select p.request_key, p.item_id, p.key_id, i.brand, i.title, i.bucket, i.file,
    row_number() over (partition by p.request_key order by i.brand, i.position, i.id) - 1 as place
  from picked p join items i on i.id = p.item_id
)
, chosen as (
  select p.* from placed p join decided d using (request_key)
  where coalesce(len(d.item_ids), 0) = 0 or list_contains(d.item_ids, coalesce(p.key_id, p.place))
)"""
)

LINKED = (
    PLACED
    + """
, linked as (
  select *, case when bucket = 'public files' then 'https://files.example/storage/v1/object/public/' || url_encode(bucket) || '/'
    || replace(url_encode(file), '%2F', '/') end as url from chosen
)"""
)

LANG_SQL = f"case when lang in ('es', 'en', 'pt', 'de', 'it') then lang else {case_sql('brand', BRAND_LANGS, repr(DEFAULT_LANG))} end"


class Sends(Parts):
    """The steps of a delivery over one inbox."""

    def __init__(self, t, settle=False):
        super().__init__(t, t.send_requests, workspace(t.spark) if settle else None)
        self.requests = t.send_requests.withColumn("request_key", customer.request_key())
        self.decided = op.decide(self.requests, self.bought)

    def placed(self, only_chosen=False):
        rights = customer.entitlements(self.bought, self.t.items)
        return op.deliverable_items(self.decided, rights, self.t.items, self.folder, only_chosen)

    def linked(self):
        return op.with_links(op.chosen_items(self.placed(True), self.requests), BASE_URL, PUBLIC)

    def addressed(self):
        asked = op.with_address(self.requests).withColumn("lang", op.message_language(F.col("lang"), F.col("brand")))
        return op.addressee(asked, self.bought)


@query("F01_paid_purchases", _for_sends(ENTITLED) + " select request_key, transaction, status from bought where paid")
def _(t):
    return op.paid_purchases(Sends(t).bought).select("request_key", "transaction", "status")


@query(
    "F02_manual_items",
    "select id as item_id, brand, title, bucket, file, position from items where active and section = 'principal'",
)
def _(t):
    return op.manual_items(t.items)


@query("F03_delivery_decision", DECIDED + " select request_key, listed, base from decided")
def _(t):
    return Sends(t).decided.select("request_key", "listed", "base")


@query("F03_deliverable_items", PLACED + " select request_key, item_id, place from placed")
def _(t):
    return Sends(t).placed().select("request_key", "item_id", "place")


@query(
    "F04_requested_items",
    PLACED + """ select distinct a.request_key, i.id as item_id from asked a join items i on i.active and i.brand = a.brand
    and (i.product_id = a.product or list_contains(i.unlocked_by, a.product))""",
)
def _(t):
    return op.requested_items(Sends(t).requests, t.items).select("request_key", "item_id")


@query("F05_chosen_items", PLACED + " select request_key, item_id, place from chosen")
def _(t):
    s = Sends(t)
    return op.chosen_items(s.placed(True), s.requests).select("request_key", "item_id", "place")


@query("F06_public_links", LINKED + " select request_key, item_id, url from linked")
def _(t):
    return Sends(t).linked().select("request_key", "item_id", "url")


@query(
    "F07_address_check",
    rf"""
, cleaned as (select author_id, lower({TRIMMED.format('to_address')}) as to_address from send_requests)
select author_id, to_address, regexp_full_match(to_address, '[^\s@]+@[^\s@]+\.[^\s@]{{2,}}') as valid_address from cleaned""",
)
def _(t):
    return op.with_address(t.send_requests).select("author_id", "to_address", "valid_address")


@query("F08_message_language", f"select author_id, {LANG_SQL} as lang from send_requests")
def _(t):
    return t.send_requests.select("author_id", op.message_language(F.col("lang"), F.col("brand")).alias("lang"))


NAMED = """
, buyers as (
  select request_key, name from bought where paid
  qualify row_number() over (partition by request_key order by approved_at desc nulls last, registered_at desc, transaction desc) = 1
)
, named as (
  select d.request_key, split_part(trim(coalesce(d.name, case when coalesce(len(d.products), 0) = 0 then b.name end, '')), ' ', 1) as first_name from decided d left join buyers b using (request_key)
)"""


@query("F09_first_name", DECIDED + NAMED + " select request_key, first_name from named")
def _(t):
    return Sends(t).addressed().select("request_key", "first_name")


def _text(part: str) -> str:
    return case_sql("lang", {lang: texts[part] for lang, texts in MAIL_TEXTS.items()}, "null")


def _escaped(expr: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        expr = f"replace({expr}, '{char}', '{entity}')"
    return expr


@query(
    "F10_rendered_message",
    LINKED + NAMED + f"""
, mails as (
  select d.request_key, d.author_id, d.brand, {LANG_SQL.replace('lang', 'd.lang').replace('case brand', 'case d.brand')} as lang,
    {case_sql('d.brand', BRAND_NAMES, 'd.brand')} as brand_name, n.first_name, {TRIMMED.format('d.message')} as extra,
    string_agg(l.title || ': ' || l.url, chr(10) order by l.place) as links,
    string_agg('<li>' || {_escaped('l.title')} || ' <a href="' || {_escaped('l.url')} || '">{{button}}</a></li>', '' order by l.place) as html_links,
    string_agg(l.title, ', ' order by l.place) as files
  from decided d join linked l using (request_key) join named n using (request_key) where l.url is not null group by all
)
, worded as (
  select *, {_text('subject')} as subject_t, {_text('hello')} as hello, {_text('intro')} as intro, {_text('note')} as note, {_text('end')} as ending,
    {_text('button')} as button, case when first_name <> '' then ' ' || first_name else '' end as greeting from mails
)
select request_key, lang, replace(subject_t, '{{marca}}', brand_name) as subject, files,
  hello || greeting || chr(10) || chr(10) || intro || chr(10) || case when extra <> '' then chr(10) || extra || chr(10) else '' end || chr(10) || links
    || chr(10) || chr(10) || note || chr(10) || ending as plain,
  '<!doctype html><html><body><h2>' || {_escaped('brand_name')} || '</h2><h1>' || {_escaped('hello')} || {_escaped('greeting')} || '</h1><p>'
    || {_escaped('intro')} || '</p>' || case when extra <> '' then '<p>' || replace({_escaped('extra')}, chr(10), '<br>') || '</p>' else '' end
    || '<ul>' || replace(html_links, '{{button}}', {_escaped('button')}) || '</ul><p>' || {_escaped('note')} || '</p><p>' || {_escaped('ending')}
    || '</p></body></html>' as html
from worded""",
)
def rendered(t):
    s = Sends(t, settle=True)
    mails = op.rendered(s.addressed(), s.linked())
    return mails.select("request_key", "lang", "subject", F.array_join("files", ", ").alias("files"), "plain", "html")



ANSWER = "case when {0}.status < 300 then 'ok' else concat('resend ', {0}.status, ': ', '{{}}') end"


@query(
    "F26_delivery_records",
    LINKED + f"""
, files as (select request_key, string_agg(title, ', ' order by place) as files from linked where url is not null group by all)
select d.author_id, d.brand, {LANG_SQL.replace('lang', 'd.lang').replace('case brand', 'case d.brand')} as lang, lower({TRIMMED.format('d.to_address')}) as to_address,
  f.files, d.base, {ANSWER.format('d')} as result, d.by_whom, {NOW} as created_at
from decided d join files f using (request_key)""",
)
def _(t):
    s = Sends(t, settle=True)
    answers = op.with_address(s.decided).withColumns({"ok": F.col("status") < 300, "body": F.lit(None).cast("string")})
    records = op.delivery_records(op.rendered(s.addressed(), s.linked()), answers, AS_OF)
    return records.withColumn("files", F.array_join("files", ", ")).drop("subject")


@query(
    "F23_send_result",
    """select page_id, case when page_id % 5 <> 0 then 'ok' else 'resend ' || cast(400 + page_id % 100 as string) || ': ' || left(html, 300) end as result
    from pages""",
)
def _(t):
    ok, status = F.col("page_id") % 5 != 0, 400 + F.col("page_id") % 100
    return t.pages.select("page_id", op.send_result(ok, status, F.col("html")).alias("result"))
