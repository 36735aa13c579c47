"""Queries of the unanswered-thread queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlake.constants import URGENCY
from inboxlake.operators import threads as op
from inboxlake.plans.language import votes_sql, winner_sql
from inboxlake.plans.registry import NOW, query
from inboxlake.sources.derived import AS_OF

T = op.THREAD
KEYS = "author_id, brand, channel"

# --- checking SQL, step by step ---------------------------------------------

RECENT = f"""
, window_rows as (
  select * from messages where created_at >= {NOW} - interval '7 days' and author_id is not null and author_id <> ''
)"""

SENDS = """
, sends as (
  select ref as author_id, brand, 'dm' as channel, sent_at from reply_queue where sent_at is not null and channel = 'dm'
  union all
  select m.author_id, q.brand, 'comentario', q.sent_at
  from reply_queue q, messages m
  where q.sent_at is not null and q.channel <> 'dm' and m.message_id = q.ref
)"""

GROUPS = (
    RECENT
    + SENDS
    + f"""
, rolled as (
  select {KEYS}, max(nullif(author, '')) as author, max(created_at) filter (direction = 'entrada') as last_in,
    max(created_at) filter (direction = 'saida') as last_message_out
  from window_rows group by all
)
, bounded as (
  select r.* exclude (last_message_out),
    greatest(coalesce(r.last_message_out, timestamp '2000-01-01'), coalesce(s.at, timestamp '2000-01-01')) as last_out
  from rolled r left join (select {KEYS}, max(sent_at) as at from sends group by all) s using ({KEYS})
)
, open_threads as (select * from bounded where last_in > last_out)
"""
)

WAITING = (
    GROUPS
    + f"""
, open_rows as (
  select w.*, row_number() over (partition by {KEYS} order by w.created_at desc, w.id desc) as newest
  from window_rows w join open_threads o using ({KEYS}) where w.direction = 'entrada' and w.created_at > o.last_out
)
, waits as (
  select {KEYS}, min(created_at) as waiting_since, count(*) as n_unanswered,
    count(*) filter (coalesce(text, '') = '') as n_media,
    string_agg(distinct category, ', ' order by category) as categories,
    max(text) filter (newest = 1) as last_text, max(message_id) filter (newest = 1) as last_message_id
  from open_rows group by all
)
, waiting as (
  select o.*, w.waiting_since, coalesce(w.n_unanswered, 0) as n_unanswered, coalesce(w.n_media, 0) as n_media,
    w.categories, w.last_text, w.last_message_id
  from open_threads o left join waits w using ({KEYS})
)"""
)


def tenths(micros: str, unit_seconds: int) -> str:
    """Micros as units with one decimal, half away from zero, without floating point until the end."""
    tenth = unit_seconds * 100_000
    return f"(sign({micros}) * ((abs({micros}) + {tenth // 2}) // {tenth}) / 10.0)"


def micros_since(column: str) -> str:
    return f"(epoch_us({NOW}) - epoch_us({column}))"


HOUR_24 = 24 * 3600 * 1_000_000

CLOCKS = (
    WAITING
    + f"""
, clocks as (
  select *, {tenths(micros_since('waiting_since'), 3600)} as hours_waiting,
    case when channel = 'dm' then {tenths(f"({HOUR_24} - {micros_since('last_in')})", 3600)} end as window_24h,
    case when channel = 'dm' then {tenths(f"({7 * HOUR_24} - {micros_since('last_in')})", 3600)} end as window_7d
  from waiting
)"""
)

STATES = """
, states as (
  select * from (
    select *, row_number() over (partition by conversation_id, brand order by updated_at desc nulls first, id desc) as newest
    from case_state) where newest = 1
)"""

QUEUED = f"""
, queued as (
  select distinct author_id, brand, 'dm' as channel from (select ref as author_id, brand from reply_queue where sent_at is null and channel = 'dm')
  union
  select w.author_id, q.brand, 'comentario' from reply_queue q, window_rows w
  where q.sent_at is null and q.channel <> 'dm' and w.channel = 'comentario' and w.message_id = q.ref
)"""

LANGUAGES = f"""
, samples as (
  select author_id, string_agg(text, ' ' order by n) as sample from (
    select author_id, text, row_number() over (partition by author_id order by created_at desc, id desc) as n
    from messages where direction = 'entrada' and coalesce(text, '') <> '')
  where n <= 6 group by author_id
)
, sample_votes as (select author_id, {votes_sql('sample')} from samples)"""

CASES = (
    "case when reply_queued then {0} when categories = 'SPAM' then {1} when categories = 'ELOGIO' then {2} "
    "when categories like '%FRAUDE%' then {3} when channel = 'comentario' and hours_waiting >= 12 then {4} "
    "when channel = 'dm' and window_24h >= 0 and window_24h <= 6 then {5} when channel = 'dm' and window_24h > 6 then {6} "
    "when channel = 'comentario' then {7} when channel = 'dm' and window_7d > 0 then {8} else {9} end"
)
URGENCY_SQL = CASES.format(*[str(level) for level, _ in URGENCY])
REASON_SQL = CASES.format(*[f"'{label}'" for _, label in URGENCY])

FULL = (
    CLOCKS
    + STATES
    + QUEUED
    + f"""
, joined as (
  select c.*, s.state, s.given_email, greatest(s.paused_until, p.paused_until) as paused_until,
    coalesce(p.reason, s.pause_reason) as pause_reason, q.author_id is not null as reply_queued
  from clocks c
  left join states s on s.conversation_id = c.author_id and s.brand = c.brand
  left join pauses p on p.conversation_id = c.author_id
  left join queued q on q.author_id = c.author_id and q.brand = c.brand and q.channel = c.channel
)
, classed as (select *, {URGENCY_SQL} as urgency, {REASON_SQL} as urgency_reason from joined)"""
)

REPORT = f"""{NOW} as as_of, author, {KEYS}, last_in,
  case when last_out <> timestamp '2000-01-01' then last_out end as last_out, waiting_since, hours_waiting, window_24h,
  window_7d, cast(n_unanswered as int) as n_unanswered, cast(n_media as int) as n_media, categories, last_text,
  last_message_id, state, given_email, paused_until, pause_reason, reply_queued, urgency, urgency_reason"""

# --- queries ----------------------------------------------------------------


def _window(t):
    return op.recent(t.messages, AS_OF, 7)


def _bounded(t):
    return op.last_outbound(op.thread_rollup(_window(t)), op.queue_sends(t.reply_queue, t.messages))


def _waiting(t):
    return op.waiting_threads(t.messages, t.reply_queue, AS_OF, 7, fetch=t.messages_of)


def _queued(t):
    return op.with_queued(op.with_clocks(_waiting(t), AS_OF), t.reply_queue, _window(t))


@query("A01_recent_messages", RECENT + f" select id, {KEYS}, direction, created_at, text from window_rows")
def _(t):
    return _window(t).select("id", *T, "direction", "created_at", "text")


@query("A02_queue_sends", SENDS + f" select {KEYS}, sent_at from sends")
def _(t):
    return op.queue_sends(t.reply_queue, t.messages).select(*T, "sent_at")


@query("A03_thread_rollup", GROUPS + f" select {KEYS}, author, last_in, last_message_out from rolled")
def _(t):
    return op.thread_rollup(_window(t)).select(*T, "author", "last_in", "last_message_out")


@query("A04_last_outbound", GROUPS + f" select {KEYS}, last_out from bounded")
def _(t):
    return _bounded(t).select(*T, "last_out")


@query("A05_unanswered_threads", GROUPS + f" select {KEYS}, last_in, last_out from open_threads")
def _(t):
    return op.unanswered(_bounded(t)).select(*T, "last_in", "last_out")


@query("A06_waiting_since", WAITING + f" select {KEYS}, waiting_since, n_unanswered from waiting")
def _(t):
    return _waiting(t).select(*T, "waiting_since", "n_unanswered")


@query("A07_media_count", WAITING + f" select {KEYS}, n_media from waiting")
def _(t):
    return _waiting(t).select(*T, "n_media")


@query("A08_categories", WAITING + f" select {KEYS}, categories from waiting")
def _(t):
    return _waiting(t).select(*T, "categories")


@query("A09_newest_inbound", WAITING + f" select {KEYS}, last_text, last_message_id from waiting")
def _(t):
    return _waiting(t).select(*T, "last_text", "last_message_id")


@query(
    "A10_author_language",
    GROUPS + LANGUAGES + f" select {KEYS}, {winner_sql('brand')} as lang from open_threads left join sample_votes using (author_id)",
)
def _(t):
    return op.with_thread_language(op.unanswered(_bounded(t)), t.messages, t.messages_of).select(*T, "lang")


@query("A11_hours_waiting", CLOCKS + f" select {KEYS}, hours_waiting from clocks")
def _(t):
    return op.with_clocks(_waiting(t), AS_OF).select(*T, "hours_waiting")


@query("A12_window_clocks", CLOCKS + f" select {KEYS}, window_24h, window_7d from clocks")
def _(t):
    return op.with_clocks(_waiting(t), AS_OF).select(*T, "window_24h", "window_7d")


@query(
    "A13_latest_state",
    STATES + """ select conversation_id as author_id, brand, state, given_email, paused_until as state_paused_until,
    pause_reason as state_pause_reason from states""",
)
def _(t):
    return op.latest_state(t.case_state)


@query(
    "A14_pause_merge",
    STATES + """ select s.conversation_id as author_id, s.brand, greatest(s.paused_until, p.paused_until) as paused_until,
    coalesce(p.reason, s.pause_reason) as pause_reason from states s left join pauses p using (conversation_id)""",
)
def _(t):
    return op.with_pause(op.latest_state(t.case_state), t.pauses).select("author_id", "brand", "paused_until", "pause_reason")


@query(
    "A15_reply_queued",
    WAITING + QUEUED + f""" select {KEYS}, exists (select 1 from queued q where q.author_id = w.author_id and q.brand = w.brand
    and q.channel = w.channel) as reply_queued from waiting w""",
)
def _(t):
    return _queued(t).select(*T, "reply_queued")


@query("A16_urgency_class", FULL + f" select {KEYS}, urgency from classed")
def _(t):
    return op.with_urgency(_queued(t)).select(*T, "urgency")


@query("A17_urgency_reason", FULL + f" select {KEYS}, urgency_reason from classed")
def _(t):
    return op.with_urgency(_queued(t)).select(*T, "urgency_reason")


def _queue(t, language, days=7):
    return op.queue(t.messages, t.reply_queue, t.case_state, t.pauses, AS_OF, days, language, t.messages_of)


@query("A18_output_projection", FULL + f" select {REPORT} from classed")
def _(t):
    return _queue(t, language=False)


@query(
    "A19_queue",
    FULL + LANGUAGES + f" select {REPORT}, {winner_sql('brand')} as lang from classed left join sample_votes using (author_id)",
)
def _(t):
    return _queue(t, language=True)


@query(
    "A19_queue_30_days",
    (FULL + LANGUAGES).replace("interval '7 days'", "interval '30 days'")
    + f" select {REPORT}, {winner_sql('brand')} as lang from classed left join sample_votes using (author_id)",
)
def _(t):
    return _queue(t, language=True, days=30)


@query(
    "A19_queue_by_urgency",
    FULL + " select urgency, channel, count(*) as n, max(hours_waiting) as longest_wait from classed group by all",
)
def _(t):
    grouped = _queue(t, language=False).groupBy("urgency", "channel")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("hours_waiting").alias("longest_wait"))
