"""Inbox tables derived from the given test tables.

Each derivation is one SELECT that both Spark and the checking engine can run,
so that both see the same rows. They use whole tables and whole texts. The one
dialect difference is the array constructor, see ``array_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _brand(key: str) -> str:
    return (
        f"('brand_' || case cast({key} % 4 as int) when 0 then 'es' when 1 then 'en' when 2 then 'it' else 'de' end)"
    )


def _author(key: str) -> str:
    return f"cast(1000000000000000 + {key} as string)"


NOW = f"timestamp '{AS_OF}'"

# the comment an action is about, some of them wrong on purpose
MODERATED = """case when id % 31 = 0 then 'x' else message_id end as message_id,
  case when id % 29 = 0 then 'brand_xx' else brand end as brand, case when id % 37 = 0 then 'dm' else channel end as channel,
  case when id % 41 = 0 then null else author_id end as author_id, case when id % 2 = 0 then author else null end as author, 'agent' as by_whom
from messages where direction = 'entrada' and channel <> 'dm'"""

DERIVATIONS = {
    "messages": f"""
select e.event_id as id, {_brand('e.user_id')} as brand,
  case when e.event_id % 5 < 3 then 'dm' when e.event_id % 5 = 3 then 'comentario' else 'comentario_fb' end as channel,
  {_author('e.user_id')} as conversation_id,
  case when e.event_id % 11 = 0 then null when e.event_id % 7 = 0 then '' else 'user_' || cast(e.user_id as string) end as author,
  {_author('e.user_id')} as author_id,
  case when e.event_type in ('click', 'view', 'signup') then 'entrada' else 'saida' end as direction,
  case when e.event_id % 10 = 0 then '' when e.event_id % 13 = 0 then null
       when e.event_id % 17 = 0 then d.text || ' Cust' || cast(e.user_id as string) || '@mail.example.com '
       else d.text end as text,
  case when e.event_id % 6 = 0 then 'pt:' || cast(e.event_id as string) else null end as text_pt,
  case cast(e.event_id % 8 as int) when 0 then 'SPAM' when 1 then 'ELOGIO' when 2 then 'FRAUDE' when 3 then 'ACESSO'
       when 4 then 'REEMBOLSO' else null end as category,
  cast(10000000000000000 + e.event_id as string) as message_id,
  cast(e.ts as timestamp) as created_at,
  case when e.event_id % 5 >= 3 and e.event_id % 97 = 0 then cast(e.ts as timestamp) + interval '1' hour else null end as deleted_at,
  case when e.event_id % 5 >= 3 and e.event_id % 89 = 0 then cast(e.ts as timestamp) + interval '1' hour else null end as hidden_at
from (select *, event_id % (select count(*) from documents) as doc_ref from events) e
left join documents d on d.doc_id = e.doc_ref
union all
select 1000000000000 + conv_id * 1000 + turn, {_brand('conv_id')}, 'dm', {_author('conv_id')},
  'user_' || cast(conv_id as string), {_author('conv_id')}, case when role = 'user' then 'entrada' else 'saida' end, text, null,
  null, cast(10000000000000000 + 1000000000000 + conv_id * 1000 + turn as string),
  {NOW} - (conv_id % 40 + 1) * interval '1' day + turn * interval '7' minute, null, null
from conversations""",
    "reply_queue": f"""
select cast(2000000000000 + c_custkey as bigint) as id, {_brand('c_custkey')} as brand, 'dm' as channel,
  {_author('c_custkey')} as ref, 'reply ' || cast(c_custkey as string) as text,
  case when c_custkey % 2 = 0 then 'tela:agent' else null end as origin,
  {NOW} - (c_custkey % 240 + 1) * interval '1' hour as created_at,
  case when c_custkey % 3 = 0 then null else {NOW} - (c_custkey % 240) * interval '1' hour end as sent_at,
  case when c_custkey % 3 = 0 then null else 'ok' end as result
from customer
union all
select id, brand, case when id % 2 = 0 then 'comentario_publico' else 'comentario_privado' end, message_id,
  coalesce(text, 'reply ' || message_id), null, created_at,
  case when id % 3 = 0 then null else created_at + interval '1' hour end, case when id % 3 = 0 then null else 'ok' end
from messages where channel = 'comentario' and category is null""",
    "case_state": f"""
select cast(c_custkey as bigint) as id, {_brand('c_custkey')} as brand, {_author('c_custkey')} as conversation_id,
  case when c_custkey % 10 = 0 then null when c_custkey % 9 = 0 then '' else 'name_' || cast(c_custkey as string) end as author,
  case c_mktsegment when 'BUILDING' then 'resolvido' when 'FURNITURE' then null else 'aguardando_email' end as state,
  case when c_custkey % 4 = 0 then '' when c_custkey % 7 = 0 then null
       else 'CUST' || cast(c_custkey as string) || '@mail.example.com' end as given_email,
  c_nationkey as attempts, '{{"origem":"bot"}}' as context,
  case when c_custkey % 8 = 0 then {NOW} + (c_custkey % 50) * interval '1' hour else null end as paused_until,
  case when c_custkey % 8 = 0 then 'bot' else null end as pause_reason,
  {NOW} - (c_custkey % 700) * interval '1' hour as updated_at
from customer
union all
select cast(1000000000000 + c_custkey as bigint), {_brand('c_custkey')}, {_author('c_custkey')}, null,
  'aguardando_email', null, 0, null, null, null, {NOW} - (c_custkey % 700 + 5) * interval '1' hour
from customer where c_mktsegment = 'MACHINERY'""",
    "pauses": f"""
select {_author('c_custkey')} as conversation_id, {_brand('c_custkey')} as brand, c_name as author, 'human' as reason,
  {NOW} + (c_custkey % 72 - 36) * interval '1' hour as paused_until
from customer""",
    "purchases": """
select 'HP' || cast(10000000 + o_orderkey as string) as transaction,
  'Cust' || cast(o_custkey as string) || '@mail.example.com' as email,
  'Name' || cast(o_custkey as string) || ' Family' as name,
  cast(o_orderkey % (select count(*) from part) as bigint) as product_id,
  'product_' || cast(o_orderkey % (select count(*) from part) as string) as product_name,
  case when o_orderkey % 31 = 0 then null when o_orderstatus = 'F' then 'APPROVED'
       when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'COMPLETE' when o_orderstatus = 'O' then 'COMPLETED'
       else 'CANCELLED' end as status,
  cast(o_totalprice as decimal(18,2)) as amount, 'USD' as currency,
  case when o_orderstatus = 'P' then null else 1700000000000 + cast(o_orderkey as bigint) * 60000 end as approved_ms,
  cast(o_orderdate as timestamp) as registered_at,
  case when o_orderkey % 4 = 0 then '{"data":{"purchase":{"payment":{"type":"PAYPAL"}},"buyer":{"address":{"country_iso":"MX"}}}}'
       else '{"data":{"purchase":{"payment":{"type":"CREDIT_CARD"},"checkout_country":{"iso":"US"}}}}' end as raw
from orders""",
    "items": f"""
select cast(p_partkey as bigint) as id, {_brand('p_partkey')} as brand, p_name as title,
  case when p_partkey % 3 = 0 then 'public files' else 'private' end as bucket,
  'dir ' || cast(p_partkey % 5 as string) || '/file' || cast(p_partkey as string) || '.pdf' as file,
  cast(p_partkey as bigint) as product_id,
  array(cast(p_partkey as bigint), cast((p_partkey + 7) % (select count(*) from part) as bigint)) as unlocked_by,
  p_partkey % 9 <> 0 as active,
  case when p_type in ('PROMO', 'ECONOMY') then 'principal' else 'complemento' end as section,
  case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then -p_size else p_size end as position
from part""",
    "accesses": """
select case when l.l_returnflag = 'N' then 'login' else 'download' end as event,
  case when l.l_returnflag = 'N' then null
       when l.l_linenumber <= 3 then 'dir ' || cast((l.l_orderkey % l.n) % 5 as string) || '/file' || cast(l.l_orderkey % l.n as string) || '.pdf'
       else 'dir ' || cast(l.l_partkey % 5 as string) || '/file' || cast(l.l_partkey as string) || '.pdf' end as file,
  'CUST' || cast(o.o_custkey as string) || '@mail.example.com' as email,
  cast(l.l_shipdate as timestamp) + l.l_suppkey * interval '1' minute as created_at
from (select *, (select count(*) from part) as n from lineitem) l
join orders o on o.o_orderkey = l.l_orderkey""",
    "refunds": f"""
select cast(o_orderkey as bigint) as id, {_brand('o_custkey')} as brand, 'dm' as channel, cast(null as string) as author,
  case when o_orderkey % 20 = 0 then null else {_author('o_custkey')} end as author_id,
  case when o_orderkey % 30 = 0 then null when o_orderkey % 7 = 0 then 'Cust' || cast(o_custkey as string) || '@mail.example.com'
       else 'alt' || cast(o_custkey as string) || '@mail.example.com' end as email,
  array('HP' || cast(10000000 + o_orderkey as string), 'HP' || cast(10000001 + o_orderkey as string)) as transactions,
  cast(o_totalprice as decimal(18,2)) as total, 'USD' as currency, case when o_orderkey % 3 = 0 then null else 'late' end as reason,
  case cast(o_orderkey % 3 as int) when 0 then 'sem_resposta' when 1 then 'perguntado' else 'espontaneo' end as reason_source,
  cast(o_orderdate as timestamp) as requested_at, case when o_orderkey % 4 = 0 then cast(o_orderdate as timestamp) else null end as guided_at,
  cast(null as string) as note, cast(o_orderdate as timestamp) as created_at
from orders""",
    "purchase_checks": f"""
select {_brand('o_custkey')} as brand, {_author('o_custkey')} as conversation_id, cast(null as string) as author,
  'Cust' || cast(o_custkey as string) || '@mail.example.com' as email_checked, 'bot' as origin,
  case when o_orderstatus = 'P' then 'nao_encontrada' else 'encontrada' end as result, cast(o_orderkey % 3 as int) as n_found,
  'none' as action_taken, 'bot' as decided_by, o_orderstatus <> 'P' as approved, '{{"raw":1}}' as api_response,
  cast(o_orderdate as timestamp) + o_orderkey * interval '1' second as created_at
from orders""",
    "pending_replies": """
select case when channel = 'dm' then author_id else message_id end as ref, 'draft ' || message_id as text, created_at
from messages where direction = 'entrada'""",
    "corrections": f"""
select l.doc_id as id, {_brand('l.doc_id')} as brand,
  case when l.doc_id % 3 = 0 then 'comentario_publico' else 'dm' end as channel, d.lang as lang, cast(null as string) as category,
  d.text as question, d.text as before, 'shorter' as instruction, d.text as after,
  l.quality = 1 as is_rule, case when l.quality = 1 then 'be brief' else null end as rule,
  {NOW} - (l.doc_id % 5000) * interval '1' hour as created_at
from labels l join documents d on d.doc_id = l.doc_id""",
    "facts": f"""
select item_id as id, 'topic_' || cast(item_id % 5 as string) as topic, text, item_id % 6 <> 0 as active,
  {NOW} - item_id * interval '1' hour as updated_at, 'seed' as updated_by
from benchmark""",
    "deliveries": f"""
select cast(o_orderkey as bigint) as id, case when o_orderkey % 9 = 0 then null else {_author('o_custkey')} end as author_id,
  {_brand('o_custkey')} as brand, 'en' as lang, 'cust' || cast(o_custkey as string) || '@mail.example.com' as to_address,
  'files' as subject, array('title a', 'title b', 'title c', 'title ' || cast(o_orderkey as string)) as files,
  case when o_orderkey % 7 = 0 then 'confirmacao_manual' else 'compra' end as base,
  case when o_orderkey % 11 = 0 then 'resend 500: x' when o_orderkey % 13 = 0 then null else 'ok' end as result,
  case when o_orderkey % 2 = 0 then 'bot' else 'agent' end as by_whom, cast(o_orderdate as timestamp) as created_at
from orders""",
    "summaries": f"""
select author_id, brand, 'sum ' || author_id as summary, 'files' as wants, 'none' as next_step,
  max(case when category is null then created_at end) as covers_until, cast(count(*) as int) as n_msgs, {NOW} as updated_at
from messages group by author_id, brand
having max(case when category is null then created_at end) is not null""",
    "actions_reply": """
select id as seq, case when id % 23 = 0 then 'brand_xx' when brand = 'brand_de' then 'brand_es' else brand end as brand,
  case when id % 29 = 0 then 'fax' when channel = 'dm' then 'dm' when id % 2 = 0 then 'comentario_publico' else 'comentario_privado' end as channel,
  case when id % 31 = 0 then 'abc' when channel = 'dm' then author_id when id % 37 = 0 then '99999999999999999' else message_id end as ref,
  case when id % 41 = 0 then 'see banned-domain.example now' when id % 43 = 0 then 'buy at shop.com now' when id % 47 = 0 then '   '
       when id % 53 = 0 then repeat('x', 1001) when id % 17 = 0 then ' ok' || chr(10) || 'two' || chr(10) || 'three ' when id % 13 = 1 then 'thanks ' || message_id
       else coalesce(text, 'ok') end as text, 'agent' as by_whom
from messages where direction = 'entrada'""",
    "actions_ops": f"""
select cast(c_custkey as bigint) as seq,
  case cast(c_custkey % 5 as int) when 0 then 'cancel' when 1 then 'state' when 2 then 'pause' when 3 then 'refund' else 'outside' end as kind,
  case when c_custkey % 5 = 0 then cast(2000000000000 + c_custkey as bigint) else null end as target_id,
  cast(1000000000000000 + (case when c_custkey >= 60 and (c_custkey % 7 = 0 or c_custkey % 13 = 0) then c_custkey - 60 else c_custkey end)
    + (case when c_custkey % 11 = 0 then 900000000 else 0 end) as string) as conversation_id,
  {_brand('c_custkey')} as brand,
  case cast(c_custkey % 5 as int) when 1 then (case when c_custkey % 13 = 0 then 'bogus' else 'resolvido' end)
    when 3 then (case when c_custkey % 13 = 0 then 'bogus' else 'perguntado' end)
    when 4 then (case when c_custkey % 13 = 0 then 'fax' else 'dm' end) else null end as value,
  case when c_custkey % 5 = 2 then (case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then 0 else cast(c_custkey % 500 as int) end) else null end as hours,
  case when c_custkey % 4 = 0 then null else 'op_' || cast(c_custkey as string) end as author, 'agent' as by_whom
from customer""",
    "requests": f"""
select {_author('c_custkey')} as author_id,
  case when c_custkey % 5 = 0 then null else {_brand('c_custkey')} end as brand,
  c_custkey % 3 = 0 as confirm, case when c_custkey % 6 = 0 then ' paid by transfer ' else null end as justification
from customer""",
    "send_requests": f"""
select {_author('c_custkey')} as author_id, {_brand('c_custkey')} as brand,
  case when c_custkey % 10 = 0 then ' Cust' || cast(c_custkey as string) || '@Mail.example.com ' when c_custkey % 17 = 0 then 'bad address'
       else 'cust' || cast(c_custkey as string) || '@mail.example.com' end as to_address,
  case when c_custkey % 6 = 0 then 'pt' when c_custkey % 7 = 0 then 'xx' else null end as lang,
  case when c_custkey % 5 = 0 then ' Ana  Maria ' else null end as name,
  case when c_custkey % 4 = 0 then ' hello <b> & "you"' || chr(10) || 'bye ' else null end as message,
  case when c_custkey % 8 = 0 then array(cast(c_custkey % n as bigint), cast((c_custkey * 3) % n as bigint), cast(-1 as bigint))
       when c_custkey % 9 = 0 then array(cast(-5 as bigint)) else null end as products,
  case when c_custkey % 3 = 0 then array(cast(0 as bigint), cast(1 as bigint), cast(2 as bigint), cast(c_custkey % n as bigint)) else null end as item_ids,
  c_custkey % 3 = 0 as confirm, case when c_custkey % 6 = 0 then ' paid by transfer ' else null end as justification,
  case when c_custkey % 12 = 0 then 500 else 200 end as status, 'agent' as by_whom
from (select *, (select count(*) from part) as n from customer) c""",
    "suggest_requests": f"""
select {_author('c_custkey')} as author_id, {_brand('c_custkey')} as brand,
  case cast(c_custkey % 3 as int) when 0 then 'dm' when 1 then 'comentario_publico' else 'comentario_privado' end as channel,
  case when c_custkey % 7 = 0 then 'fr' when c_custkey % 11 = 0 then null when c_custkey % 4 = 1 then 'en' when c_custkey % 4 = 2 then 'it' else 'es' end as lang,
  case when c_custkey % 2 = 0 then 'melhorar' else 'sugerir' end as mode,
  case when c_custkey % 6 = 0 then 'draft ' || c_name else null end as draft,
  case when c_custkey % 2 = 0 then 'shorter, please' else null end as instruction,
  case when c_custkey % 5 = 0 then 'ACESSO, REEMBOLSO' else null end as categories,
  case when c_custkey % 3 = 0 then 'Janela de 24h aberta' else null end as urgency_reason,
  case when c_custkey % 9 = 0 then '5.5 h' else null end as window,
  case when c_custkey % 8 = 1 then 'nice deck' else null end as target_comment
from customer""",
    "summary_requests": f"""
select {_author('c_custkey')} as author_id, {_brand('c_custkey')} as brand, c_custkey % 13 = 0 as force from customer""",
    "model_outputs": f"""
select conv_id * 1000 + turn as seq, {_author('conv_id')} as author_id, {_brand('conv_id')} as brand, 'dm' as channel, 'en' as lang,
  case when turn % 2 = 0 then 'melhorar' else 'sugerir' end as mode, 'shorter' as instruction,
  case when turn % 3 = 0 then null else 'draft ' || cast(turn as string) end as draft, 'ACESSO' as categories,
  case when turn % 4 = 3 then 'no object here: ' || text when turn % 4 = 2 and role <> 'user' then text || ' {{"texto": 5, broken }}'
       else 'Sure: {{"texto":" answer ' || cast(conv_id as string) || ' ","texto_pt":"resposta","notas":null,"resumo":"r' || cast(turn as string)
         || '","quer":"q","proximo_passo":" p "}} bye' end as raw,
  'model-a' as model, cast(length(text) as bigint) as input_tokens, case when turn % 2 = 0 then null else cast(100 as bigint) end as cache_read,
  case when turn % 3 = 0 then null else cast(10 as bigint) end as cache_creation, case when turn % 5 = 0 then null else cast(turn as bigint) end as output_tokens,
  'agent' as by_whom
from conversations""",
    "translated": """
select id * 1000 + part as seq, case when id % 19 = 0 then id + 5000000000000 else id end as id, part,
  case when id % 7 = 0 and part = 0 then '  ' else ' pt ' || cast(id as string) || '.' || cast(part as string) || chr(10) end as pt
from (select id, cast(place as int) as part from (
  select id, explode(sequence(cast(0 as bigint), cast(floor((greatest(length(coalesce(text, '')), 1) - 1) / 1000) as bigint))) as place from messages))
union all
select id * 1000 + 999 as seq, id, 0 as part, ' again ' || cast(id as string) as pt from messages where id % 5 = 0""",
    "actions_facts": """
select l.doc_id as seq, case when l.toxic = 1 then 'delete' else 'save' end as kind,
  case when l.doc_id % 3 = 0 then null else l.doc_id % (select count(*) from benchmark) end as target_id,
  case when l.doc_id % 4 = 0 then ' ' when l.doc_id % 4 = 1 then null else ' ' || d.source || ' ' end as topic,
  case when l.doc_id % 11 = 0 then '  ' else ' ' || d.text || ' ' end as text, 'agent' as by_whom
from labels l join documents d on d.doc_id = l.doc_id""",
    "actions_moderation": f"""
select id as seq, case cast(id % 3 as int) when 0 then 'delete' when 1 then 'hide' else 'show' end as kind, {MODERATED}
union all
select id + 3000000000000, 'hide', {MODERATED}""",
}

# table -> tables it is derived from
NEEDS = dict.fromkeys(
    ("reply_queue", "pending_replies", "summaries", "actions_reply", "translated", "actions_moderation"), ["messages"]
)


def checking_sql(name: str) -> str:
    """A derivation in the checking engine's dialect."""
    return DERIVATIONS[name].replace("explode(sequence(", "unnest(generate_series(").replace("array(", "list_value(")


def ctes(*names: str) -> str:
    """``name as (...)`` blocks for the tables and what they need, in order."""
    ordered: list[str] = []
    for name in names:
        for table in [*NEEDS.get(name, []), name]:
            if table not in ordered:
                ordered.append(table)
    return ",\n".join(f"{name} as ({checking_sql(name)})" for name in ordered)


class Inbox:
    """The derived tables over one folder of test tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.built = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self._build(name)
        return self.built[name]

    def messages_of(self, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows of ``messages`` whose id is in the only column of ``ids`` (``left_anti``: is not), as a table with an index gives them: picked before they get texts."""
        wanted = ids.toDF("_wanted")
        self.documents.createOrReplaceTempView("documents")
        self.events.join(wanted, F.col("event_id") == F.col("_wanted"), how).createOrReplaceTempView("picked_events")
        turn = F.expr("1000000000000 + conv_id * 1000 + turn")
        self.conversations.join(wanted, turn == F.col("_wanted"), how).createOrReplaceTempView("picked_conversations")
        sql = DERIVATIONS["messages"].replace("from events)", "from picked_events)").replace("from conversations", "from picked_conversations")
        return self.spark.sql(sql)

    def replies_of(self, seqs: DataFrame, how: str = "left_semi") -> DataFrame:
        """The same for ``actions_reply`` by ``seq``, which is the id of a message."""
        self.messages_of(seqs, how).createOrReplaceTempView("picked_messages")
        return self.spark.sql(DERIVATIONS["actions_reply"].replace("from messages", "from picked_messages"))

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql = DERIVATIONS[name]
        for table in [*BASE_TABLES, *NEEDS.get(name, [])]:
            if table in sql:
                getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(sql)


class Streams(Inbox):
    """The same tables as streams: those of ``orders``, a table and the column that its rows come by, arrive in micro-batches, and texts are joined as a batch is read.

    The ordered tables, which have no texts but those of ``conversations``, are written to ``root`` as ``files`` files in ranges of the column; a batch reads ``trigger`` of each.
    """

    def __init__(self, spark: SparkSession, folder: str, root: str, orders: dict[str, str], files: int, trigger: int):
        super().__init__(spark, folder)
        for name, order in orders.items():
            rows = super()._build(name)
            rows.repartitionByRange(files, F.expr(order)).write.parquet(f"{root}/{name}")
            self.built[name] = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", trigger).parquet(f"{root}/{name}")
