"""Queries of the stuck-case report."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlake.constants import PAID_STATUSES
from inboxlake.functions.text import elapsed, instant
from inboxlake.operators import stuck as op
from inboxlake.plans.registry import NOW, query
from inboxlake.plans.threads import micros_since, tenths
from inboxlake.sources.derived import AS_OF

PAID_LIST = ", ".join(f"'{s}'" for s in PAID_STATUSES)

# facts of every conversation and address by grouping whole tables, joined to the open cases afterwards
REPORT = f"""
, spoken as (
  select author_id, max(nullif(author, '')) as speaker, max(created_at) filter (direction = 'entrada') as heard_at,
    max(created_at) filter (direction = 'saida') as said_at
  from messages group by author_id
)
, queued as (select ref, max(sent_at) as sent_at, count(*) - count(sent_at) as waiting from reply_queue group by ref)
, buyers as (select lower(email) as address, count(*) filter (status in ({PAID_LIST})) as n_paid from purchases group by all)
, report as (
  select c.id, c.conversation_id, c.brand, c.state, c.given_email, c.attempts, c.updated_at, c.paused_until, c.pause_reason,
    case when c.author <> '' then c.author else s.speaker end as author, s.heard_at as last_in,
    case when s.said_at > q.sent_at or q.sent_at is null then s.said_at else q.sent_at end as last_out,
    {tenths(micros_since("c.updated_at"), 86400)} as days_idle, coalesce(b.n_paid, 0) > 0 as has_purchase, coalesce(q.waiting, 0) > 0 as reply_queued
  from case_state c left join spoken s on s.author_id = c.conversation_id left join queued q on q.ref = c.conversation_id
  left join buyers b on b.address = lower(c.given_email) and c.given_email <> ''
  where coalesce(c.state, '') <> 'resolvido'
)"""


def _facts(t):
    return op.with_conversation_facts(op.open_cases(t.case_state), op.conversation_facts(*op.of_cases(op.open_cases(t.case_state), t.messages, t.reply_queue)))


@query("B01_open_cases", REPORT + "select id, conversation_id, brand, state from report")
def _(t):
    return op.open_cases(t.case_state).select("id", "conversation_id", "brand", "state")


@query("B02_author_fallback", REPORT + "select id, author from report")
def _(t):
    return _facts(t).select("id", "author")


@query("B03_last_contact", REPORT + "select id, last_in, last_out from report")
def _(t):
    return _facts(t).select("id", "last_in", "last_out")


@query("B04_days_idle", REPORT + "select id, days_idle from report")
def _(t):
    return op.open_cases(t.case_state).select("id", elapsed(instant(AS_OF), F.col("updated_at"), 86400).alias("days_idle"))


@query("B05_has_purchase", REPORT + "select id, has_purchase from report")
def _(t):
    return op.with_paid_flag(op.open_cases(t.case_state), t.purchases).select("id", "has_purchase")


@query("B06_reply_queued", REPORT + "select id, reply_queued from report")
def _(t):
    return _facts(t).select("id", "reply_queued")


@query(
    "B07_stuck_cases",
    REPORT + f"select {NOW} as as_of, * from report order by updated_at, id",
)
def _(t):
    return op.stuck_cases(t.case_state, t.messages, t.reply_queue, t.purchases, AS_OF)
