"""Queries that apply action logs to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlake.constants import COMMENT_CHANNELS, MODERATION_BRANDS, RECORDS
from inboxlake.operators import actions as op
from inboxlake.operators.context import parsed_output, summary_transcript, translation_backlog
from inboxlake.operators.customer import request_key
from inboxlake.operators.delivery import decide
from inboxlake.plans.customer import BOUGHT, Parts
from inboxlake.plans.delivery import DECIDED, PARTS, TRIMMED, Sends
from inboxlake.plans.registry import NOW, query
from inboxlake.sources.derived import AS_OF
from inboxlake.sources.tables import in_slices, of_slice, slices_for, workspace

FIRST_ID = 9_000_000_000_000  # ids of added rows start here

# --- replies ----------------------------------------------------------------

CHECKED = r"""
, trimmed as (select * replace (trim(coalesce(text, ''), ' ') as text) from actions_reply)
, checked as (
  select *, case
    when brand not in ('brand_es', 'brand_en', 'brand_it') then 'brand'
    when channel not in ('dm', 'comentario_publico', 'comentario_privado') then 'channel'
    when text = '' then 'empty'
    when length(text) > 1000 then 'too_long'
    when text ilike '%banned-domain.example%' then 'banned_domain'
    when channel = 'dm' and not regexp_full_match(ref, '[0-9]{10,20}') then 'dm_ref'
    when channel <> 'dm' and not regexp_full_match(ref, '[0-9]{15,20}') then 'comment_ref'
    when channel <> 'dm' and ref not in (select message_id from messages where channel = 'comentario') then 'comment_missing'
    when channel = 'comentario_publico' and length(text) - length(replace(text, chr(10), '')) > 2 then 'too_many_lines'
    when channel = 'comentario_publico' and regexp_matches(text, '(?i)(https?://|www\.|\.(com|online|net|org|io)\b)') then 'public_link'
  end as error
  from trimmed
)"""


def _checked(t):
    return op.validate_replies(t.actions_reply, t.messages, fetch=t.replies_of)


@query("E01_reply_validation", CHECKED + " select seq, brand, channel, ref, text, error from checked")
def _(t):
    return _checked(t).select("seq", "brand", "channel", "ref", "text", "error")


@query(
    "E02_reply_upsert",
    CHECKED + f"""
, good as (select * from checked where error is null)
, changes as (
  select channel, ref, min(seq) as first_seq, max(seq) as last_seq from good group by all
)
select coalesce(q.id, {FIRST_ID} + c.first_seq) as id, coalesce(g.brand, q.brand) as brand, channel, ref, coalesce(g.text, q.text) as text,
  case when g.seq is null then q.origin else 'tela:' || g.by_whom end as origin,
  case when g.seq is null then q.created_at else {NOW} end as created_at,
  case when g.seq is null then q.sent_at end as sent_at, case when g.seq is null then q.result end as result
from reply_queue q full join changes c using (channel, ref) left join good g on g.seq = c.last_seq""",
)
def _(t):
    accepted, _rejected = op.split_valid(_checked(t))
    return op.upsert_replies(t.reply_queue, accepted, AS_OF, FIRST_ID)


CANCELS = """
, cancels as (select seq, target_id from actions_ops where kind = 'cancel')
, firsts as (select target_id, min(seq) as seq from cancels where target_id in (select id from reply_queue where sent_at is null) group by all)"""


def _cancels(t):
    return t.actions_ops.filter("kind = 'cancel'").select("seq", "target_id")


@query("E03_cancel_reply", CANCELS + " select id, channel, ref, sent_at from reply_queue where id not in (select target_id from firsts)")
def _(t):
    kept, _outcome = op.cancel_replies(t.reply_queue, _cancels(t))
    return kept.select("id", "channel", "ref", "sent_at")


@query("E03_cancel_outcome", CANCELS + " select seq, target_id, seq in (select seq from firsts) as done from cancels")
def _(t):
    return op.cancel_replies(t.reply_queue, _cancels(t))[1]


# --- states, pauses, refunds, outside answers -------------------------------

STATE_LOG = """
, good as (select * from actions_ops where kind = 'state' and value in ('resolvido', 'aguardando_dono', 'aguardando_email'))
, folded as (select conversation_id, brand, min(seq) as first_seq, max(seq) as last_seq from good group by all)
, change as (
  select f.conversation_id, f.brand, f.first_seq, b.value, a.author, a.by_whom
  from folded f join good a on a.seq = f.first_seq join good b on b.seq = f.last_seq
)"""


def _states(t):
    return op.set_states(t.case_state, t.actions_ops.filter("kind = 'state'"), AS_OF, FIRST_ID)


@query(
    "E04_set_state",
    STATE_LOG + f"""
select s.id, s.brand, s.conversation_id, s.author, coalesce(c.value, s.state) as state, s.given_email, s.attempts, s.context,
  s.paused_until, s.pause_reason, s.updated_at
from case_state s left join change c using (conversation_id, brand)
union all
select {FIRST_ID} + first_seq, brand, conversation_id, author, value, null, null, '{{"origem":"tela","por":"' || by_whom || '"}}', null, null, {NOW}
from change c where not exists (select 1 from case_state s where s.conversation_id = c.conversation_id and s.brand = c.brand)""",
)
def _(t):
    return _states(t)[0]


@query("E04_set_state_rejected", "select seq, value, 'state' as error from actions_ops where kind = 'state' and value = 'bogus'")
def _(t):
    return _states(t)[1].select("seq", "value", "error")


@query(
    "E05_pause",
    f"""
, log as (select *, coalesce(hours, 0) <= 0 as ends from actions_ops where kind = 'pause')
, marks as (select conversation_id, max(seq) as last_seq, max(seq) filter (ends) as end_seq from log group by all)
, named as (
  select l.conversation_id, max(l.seq) as seq from log l join marks m using (conversation_id)
  where not l.ends and l.author is not null and (m.end_seq is null or l.seq > m.end_seq) group by all
)
, change as (
  select m.conversation_id, m.end_seq, l.ends, l.hours, l.brand, l.by_whom, n.author
  from marks m join log l on l.seq = m.last_seq left join (select x.conversation_id, l2.author from named x join log l2 on l2.seq = x.seq) n
    on n.conversation_id = m.conversation_id
)
select * from pauses p where not exists (select 1 from change c where c.conversation_id = p.conversation_id)
union all
select c.conversation_id, c.brand, coalesce(c.author, case when c.end_seq is null then p.author end),
  'humano atendendo pela tela (' || c.by_whom || ')', {NOW} + least(c.hours, 336) * interval '1' hour
from change c left join pauses p using (conversation_id) where not c.ends""",
)
def _(t):
    return op.set_pauses(t.pauses, t.actions_ops.filter("kind = 'pause'"), AS_OF)


@query(
    "E06_register_refund",
    f"""
select {FIRST_ID} + seq as id, brand, 'dm' as channel, author, conversation_id as author_id,
  lower(case when seq % 4 = 0 then null else 'Mail' || cast(seq as string) || '@X.example' end) as email,
  cast(seq as double) as total, case when seq % 3 <> 0 then 'late' end as reason, value as reason_source, {NOW} as requested_at,
  case when seq % 2 = 0 then {NOW} end as guided_at,
  case when seq % 6 = 0 then 'seen | ' else '' end || 'registrado pela tela por ' || by_whom as note
from actions_ops where kind = 'refund' and value in ('perguntado', 'espontaneo', 'sem_resposta')""",
)
def _(t):
    seq = F.col("seq")
    log = t.actions_ops.filter("kind = 'refund'").select(
        "seq", "brand", F.lit("dm").alias("channel"), "author", F.col("conversation_id").alias("author_id"), "by_whom",
        F.when(seq % 4 == 0, "").otherwise(F.concat(F.lit("Mail"), seq.cast("string"), F.lit("@X.example"))).alias("email"),
        F.array(F.concat(F.lit("HP"), seq.cast("string"))).alias("transactions"),
        seq.cast("decimal(18,2)").alias("total"), F.lit("USD").alias("currency"),
        F.when(seq % 3 == 0, "").otherwise("late").alias("reason"), F.col("value").alias("reason_source"),
        (seq % 2 == 0).alias("guided"), F.when(seq % 6 == 0, "seen").otherwise("").alias("note"),
    )
    return op.register_refunds(log, AS_OF, FIRST_ID)[0].drop("transactions", "currency", "created_at")


@query(
    "E07_answered_outside",
    f"""
select {FIRST_ID} + seq as id, brand, value as channel, conversation_id, author_id, direction, text, category, created_at, known as author from (
  select seq, brand, value, conversation_id, conversation_id as author_id, 'saida' as direction, 'HUMANO' as category, {NOW} as created_at,
    '[respondido à mão no Instagram por ' || by_whom || ']' || case when seq % 3 = 0 then ' by phone' else '' end as text,
    (select max(m.author) from messages m where m.author_id = o.conversation_id and m.author <> '') as known
  from actions_ops o where kind = 'outside' and value in ('dm', 'comentario'))""",
)
def _(t):
    log = t.actions_ops.filter("kind = 'outside'").select(
        "seq", "brand", F.col("value").alias("channel"), F.col("conversation_id").alias("author_id"), "by_whom",
        F.when(F.col("seq") % 3 == 0, "by phone").otherwise("").alias("note"),
    )
    rows = op.answered_outside(t.messages, log, AS_OF, FIRST_ID)[0]
    return rows.select(
        "id", "brand", "channel", "conversation_id", "author_id", "direction", "text", "category", "created_at", "author"
    )


# --- facts ------------------------------------------------------------------

FACT_LOG = """
, saves as (
  select seq, target_id, nullif(trim(topic, ' '), '') as topic, trim(coalesce(text, ''), ' ') as text, by_whom from actions_facts where kind = 'save')
, good as (select * from saves where text <> '')
, folded as (
  select target_id as id, max(seq) as last_seq, max(seq) filter (topic is not null) as topic_seq from good where target_id is not null group by all)"""


@query(
    "E08_fact_save",
    FACT_LOG + f"""
select f.id, coalesce(n.topic, f.topic) as topic, coalesce(l.text, f.text) as text, f.active,
  case when l.seq is null then f.updated_at else {NOW} end as updated_at, coalesce(l.by_whom, f.updated_by) as updated_by
from facts f left join folded x using (id) left join good l on l.seq = x.last_seq left join good n on n.seq = x.topic_seq
union all
select {FIRST_ID} + seq, coalesce(topic, 'geral'), text, true, {NOW}, by_whom from good where target_id is null""",
)
def _(t):
    return op.save_facts(t.facts, t.actions_facts.filter("kind = 'save'"), AS_OF, FIRST_ID)[0]


@query(
    "E09_fact_delete",
    f"""
, hits as (select target_id as id, min(seq) as seq from actions_facts where kind = 'delete' group by all)
select f.id, f.topic, f.active and h.id is null as active, case when f.active and h.id is not null then {NOW} else f.updated_at end as updated_at
from facts f left join hits h using (id)""",
)
def _(t):
    table, _outcome = op.delete_facts(t.facts, t.actions_facts.filter("kind = 'delete'"), AS_OF)
    return table.select("id", "topic", "active", "updated_at")


@query(
    "E09_fact_delete_outcome",
    """
, log as (select seq, target_id from actions_facts where kind = 'delete')
, hits as (select target_id, min(seq) as seq from log join facts f on f.id = target_id and f.active group by all)
select l.seq, l.target_id, h.seq is not null as done from log l left join hits h on h.seq = l.seq""",
)
def _(t):
    _table, outcome = op.delete_facts(t.facts, t.actions_facts.filter("kind = 'delete'"), AS_OF)
    return outcome.select("seq", "target_id", "done")


# --- moderation -------------------------------------------------------------

JUDGED = """
, targets as (
  select * from (
    select m.id as target_id, m.message_id, m.brand, m.deleted_at, m.text, row_number() over (partition by message_id, brand order by id) as n
    from messages m where direction = 'entrada') where n = 1
)
, valid as (
  select *, message_id is not null and brand is not null and channel is not null and author_id is not null as complete,
    brand in ('brand_es', 'brand_en', 'brand_it') as known_brand, channel in ('comentario', 'comentario_fb') as is_comment
  from actions_moderation
)
, judged as (
  select v.*, t.target_id, t.text as target_text, case
    when not complete then 'missing_field' when not known_brand then 'brand' when not is_comment then 'channel'
    when t.target_id is null then 'not_found'
    when t.deleted_at is not null or exists (
      select 1 from valid e where e.message_id = v.message_id and e.brand = v.brand and e.kind = 'delete' and e.seq < v.seq
        and e.complete and e.known_brand and e.is_comment)
      then case when v.kind = 'delete' then 'already_deleted' else 'conflict' end
    else 'done' end as outcome
  from valid v left join targets t on t.message_id = v.message_id and t.brand = v.brand
)"""


def _moderated(t, kinds=("delete", "hide", "show")):
    log = t.actions_moderation.filter(F.col("kind").isin(*kinds))
    return op.moderate_comments(t.messages, log, AS_OF, FIRST_ID, MODERATION_BRANDS, COMMENT_CHANNELS, t.messages_of)


@query(
    "E10_comment_delete",
    JUDGED.replace("from actions_moderation", "from actions_moderation where kind = 'delete'") + f"""
select m.id, m.direction, m.author, case when j.target_id is null then m.deleted_at else {NOW} end as deleted_at, m.text
from messages m left join (select target_id from judged where outcome = 'done') j on j.target_id = m.id
union all
select {FIRST_ID} + seq, 'saida', coalesce(nullif(author, ''), (select max(m.author) from messages m where m.author_id = j.author_id and m.author <> '')),
  null, '[respondido à mão por ' || by_whom || '] comentário apagado pela tela: "' || left(coalesce(target_text, ''), 120) || '"'
from judged j where outcome = 'done'""",
)
def comment_delete(t):
    return _moderated(t, ("delete",))[0].select("id", "direction", "author", "deleted_at", "text")


@query("E11_moderation_outcome", JUDGED + " select seq, kind, message_id, brand, outcome from judged")
def _(t):
    return _moderated(t)[1].select("seq", "kind", "message_id", "brand", "outcome")


@query(
    "E11_comment_hide",
    JUDGED + f"""
, shown as (select target_id, max(seq) filter (kind <> 'delete') as seq, count(*) filter (kind = 'delete') > 0 as deleted
  from judged where outcome = 'done' group by all)
select m.id, m.direction, case when s.deleted then {NOW} else m.deleted_at end as deleted_at,
  case when j.kind = 'hide' then {NOW} when j.kind = 'show' then null else m.hidden_at end as hidden_at, null as note
from messages m left join shown s on s.target_id = m.id left join judged j on j.seq = s.seq
union all
select {FIRST_ID} + seq, 'saida', null, null, case kind when 'delete' then '[respondido à mão por ' else '[à mão por ' end || by_whom || '] comentário '
  || case kind when 'delete' then 'apagado' when 'hide' then 'ocultado' else 'reexibido' end || ' pela tela: "'
  || left(coalesce(target_text, ''), 120) || '"'
from judged where outcome = 'done'""",
)
def _(t):
    table = _moderated(t)[0]
    note = F.when(F.col("id") >= FIRST_ID, F.col("text"))
    return table.select("id", "direction", "deleted_at", "hidden_at", note.alias("note"))


# --- records ----------------------------------------------------------------


def _approval_sql(rows: str, email: str, reason: str) -> str:
    return f"""
select brand, author_id as conversation_id, cast(null as string) as author, coalesce({email}, '{RECORDS["no_email"]}') as email_checked, 'tela' as origin,
  'confianca_manual' as result, 0 as n_found, replace('{RECORDS[reason]}', '{{reason}}', trim(justification)) as action_taken, by_whom as decided_by,
  true as approved, {NOW} as created_at
from {rows} where base = 'confirmacao_manual'"""


@query("E12_manual_approval", DECIDED + _approval_sql("decided", "lower(trim(to_address))", "mail"))
def _(t):
    decided = Sends(t).decided.withColumn("email", F.lower(F.trim("to_address")))
    return op.manual_approvals(decided, AS_OF, "mail")


@query(
    "E12_manual_approval_links",
    BOUGHT + """
, known as (select request_key, min(email) as email from emails group by all)
, payers as (select distinct request_key from bought where paid)
, judged as (
  select r.*, 'agent' as by_whom, n.email,
    case when p.request_key is null and r.confirm and length(trim(coalesce(r.justification, ''))) > 0 then 'confirmacao_manual' end as base
  from requests r join keyed k on k.author_id is not distinct from r.author_id and k.brand is not distinct from r.brand
  left join known n using (request_key) left join payers p using (request_key)
)""" + _approval_sql("judged", "email", "links"),
)
def _(t):
    p = Parts(t)
    first = p.emails.groupBy("request_key").agg(F.min("email").alias("email"))
    requests = t.requests.withColumn("request_key", request_key()).withColumn("products", F.lit(None).cast("array<bigint>"))
    requests = requests.withColumn("by_whom", F.lit("agent")).join(first, "request_key", "left")
    return op.manual_approvals(decide(requests, p.bought), AS_OF, "links")


OUTPUT = """
, spans as (select *, nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') as span from model_outputs)
, parsed as (select *, case when json_valid(span) then span end as object from spans)"""


def field_sql(name: str, otherwise: str = "''") -> str:
    return f"case when object is null then trim({otherwise}, ' ') else trim(coalesce(object ->> '$.{name}', ''), ' ') end"


def _suggestions(t):
    note = ("notas", RECORDS["not_json"])
    return parsed_output(t.model_outputs, "raw", ["texto", "texto_pt", "notas"], note)


@query(
    "E13_summary_upsert",
    OUTPUT + f"""
, made as (
  select author_id, brand, {field_sql('resumo', 'raw')} as summary, {field_sql('quer')} as wants, {field_sql('proximo_passo')} as next_step
  from (select *, row_number() over (partition by author_id, brand order by seq desc) as n from parsed) where n = 1
)
, spoken as (select author_id, max(created_at) as covers_until, cast(least(count(*), 80) as int) as n_msgs from messages group by all)
select m.author_id, m.brand, m.summary, m.wants, m.next_step, s.covers_until, coalesce(s.n_msgs, 0) as n_msgs from made m left join spoken s using (author_id)
union all
select author_id, brand, summary, wants, next_step, covers_until, n_msgs from summaries s
where not exists (select 1 from made m where m.author_id = s.author_id and m.brand = s.brand)""",
)
def _(t):
    parsed = parsed_output(t.model_outputs, "raw", ["resumo", "quer", "proximo_passo"])
    asked = t.messages.join(parsed.select("author_id").distinct(), "author_id", "left_semi")
    talk = summary_transcript(asked).select("author_id", F.col("newest_at").alias("covers_until"), "n_msgs")
    produced = parsed.join(talk, "author_id", "left").select(
        "seq", "author_id", "brand", F.col("resumo").alias("summary"), F.col("quer").alias("wants"),
        F.col("proximo_passo").alias("next_step"), "covers_until", F.coalesce("n_msgs", F.lit(0)).alias("n_msgs"),
        F.to_timestamp(F.lit(AS_OF)).alias("updated_at"),
    )
    return op.upsert_summaries(t.summaries, produced).drop("updated_at")


@query(
    "E14_translation_write_back",
    PARTS + r"""
, good as (select *, regexp_replace(pt, '^\s+|\s+$', '', 'g') as said from translated)
, last as (select id, part, said from good where said <> '' qualify row_number() over (partition by id, part order by seq desc) = 1)
, whole as (
  select p.id, string_agg(p.lead || l.said, '' order by p.part) as pt from parts p left join last l on l.id = p.id and l.part = p.part
  group by p.id having count(l.said) = count(*))
select m.id, coalesce(w.pt, m.text_pt) as text_pt from messages m left join whole w using (id)""",
)
def _(t):
    pending = translation_backlog(t.messages).filter("not done")
    return _written(t, pending, t.translated)


def _written(t, pending, translated):
    """Texts meet by id in slices of the ids, so that they are not all shuffled at a time."""
    n = slices_for(t.messages)

    def write(k):
        rows = (table.where(of_slice("id", k, n)) for table in (t.messages, pending, translated))
        return op.write_translations(*rows).select("id", "text_pt")

    return in_slices(write, n, workspace(t.spark), "written")


@query(
    "E14_identity_translation",
    rf"""
select id, case when coalesce(text_pt, '') <> '' then text_pt when id > 0 and {TRIMMED.format('text')} <> '' then {TRIMMED.format('text')} else text_pt end as text_pt from messages""",
)
def _(t):
    """A translation that gives every part back as it is: texts must come back whole."""
    pending = translation_backlog(t.messages).filter("not done")
    made = pending.select(F.lit(1).cast("long").alias("seq"), "id", "part", F.col("text").alias("pt"))
    return _written(t, pending, made)


@query(
    "E15_suggestion_log",
    OUTPUT + f"""
select author_id, brand, channel, lang, mode, instruction, draft, {field_sql('texto', 'raw')} as suggestion, {field_sql('texto_pt')} as suggestion_pt,
  model, coalesce(input_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_creation, 0) as tokens_in, coalesce(output_tokens, 0) as tokens_out,
  by_whom, {NOW} as created_at
from parsed""",
)
def _(t):
    produced = _suggestions(t).withColumnsRenamed({"texto": "suggestion", "texto_pt": "suggestion_pt"})
    return op.log_suggestions(produced, AS_OF)


@query(
    "E16_correction_log",
    OUTPUT + rf"""
, last as (
  select author_id, arg_max(text, n) as question from (
    select author_id, text, direction, -row_number() over (partition by author_id order by created_at desc, id desc) as n from messages
    qualify n >= -30)
  where direction = 'entrada' and regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' group by all
)
select {FIRST_ID} + seq as id, brand, channel, cast(null as string) as author, lang, categories as category, l.question, coalesce(draft, '') as before,
  instruction, {field_sql('texto', 'raw')} as after, {NOW} as created_at
from parsed left join last l using (author_id) where mode = 'melhorar' and {field_sql('texto', 'raw')} <> ''""",
)
def _(t):
    produced = _suggestions(t).withColumnRenamed("texto", "suggestion")
    return op.log_corrections(produced, t.messages, AS_OF, FIRST_ID)
