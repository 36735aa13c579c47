"""The registered queries of the pipeline operators, with checking SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlake.llm import alignment, factorisation, minhash, packing, pieces, quality_rules, resampling, sharding, simhash, suffix_dedup, tool_links, url_filter, vafile
from inboxlake.llm.common import bounded
from inboxlake.sources.tables import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: Tools that the derived calls name, with the fields of their arguments.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "deep": ("boolean", False)},
    "fetch": {"query": ("string", True), "limit": ("integer", False)},
    "count": {"query": ("string", True), "limit": ("number", True), "deep": ("boolean", True)},
}

# Assistant turns as calls: the argument text has its keys in an order that is not canonical, and lacks or spoils one now and then.
_CALLS = """
select conv_id, cast(conv_id as string) || ':' || cast(turn as string) as call_id, turn,
  case when length(text) % 4 = 0 then 'search' when length(text) % 4 = 1 then 'fetch' when length(text) % 4 = 2 then 'count' else 'guess' end as name,
  text, length(text) as n, cast(conv_id as string) || ':' || cast(turn div 2 as string) as needs
from conversations where role = 'assistant'
"""


@query(
    "op2_tool_links",
    """
with recursive calls as (
  select conv_id, conv_id || ':' || turn as call_id, turn, length(text) as n, text,
    case length(text) % 4 when 0 then 'search' when 1 then 'fetch' when 2 then 'count' else 'guess' end as name,
    case when length(text) % 11 > 0 then to_json(text) end as q,
    case when length(text) % 7 = 0 then '"' || length(text) || '"' else cast(length(text) as varchar) end as lim,
    case when length(text) % 3 > 0 then case when length(text) % 2 = 0 then 'true' else 'false' end end as deep,
    conv_id || ':' || (turn // 2) as needs
  from conversations where role = 'assistant'
), parents as (
  select c.conv_id, c.call_id, p.call_id as needs from calls c left join calls p on p.call_id = c.needs and p.call_id <> c.call_id
), levels as (
  select call_id, 0 as level from parents where needs is null
  union all
  select p.call_id, l.level + 1 from parents p join levels l on p.needs = l.call_id
), results as (
  select conv_id, conv_id || ':' || (turn - 1) as call_id, turn, text from conversations where role = 'user' and turn > 0
), checked as (
  select *,
    case when name = 'guess' then 'unknown tool' else concat_ws('; ',
      case when name = 'count' and deep is null then 'deep is missing' end,
      case when name = 'fetch' and deep is not null then 'deep is unknown' end,
      case when n % 7 = 0 then 'limit is not ' || case name when 'count' then 'number' else 'integer' end end,
      case when q is null then 'query is missing' end) end as problems,
    '{' || concat_ws(',', '"deep":' || deep, '"limit":' || lim, '"query":' || q) || '}' as arguments
  from calls
)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as turn, l.level,
  case when c.call_id is null then 'orphan' when r.call_id is null then 'pending' else 'answered' end as status,
  coalesce(c.problems, '') = '' as valid, coalesce(c.problems, '') as problems,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","name":'
    || coalesce('"' || c.name || '"', 'null') || ',"result":' || case when r.call_id is null then 'null' else to_json(r.text) end || '}' as line
from checked c full join results r on c.call_id = r.call_id left join levels l on l.call_id = c.call_id
""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as calls, each needing the call at half its turn, and the user turns after them as results."""
    turns = table(spark, folder, "conversations")
    calls = spark.sql(_CALLS.replace("from conversations", "from {conversations}"), conversations=turns)
    n = F.col("n")
    # to_json leaves null fields out; the limit becomes text where its field is a string
    loose = F.to_json(F.struct(F.when(n % 11 > 0, F.col("text")).alias("query"), F.when(n % 7 > 0, n).alias("limit"), F.when(n % 3 > 0, n % 2 == 0).alias("deep")))
    spoiled = F.to_json(F.struct(F.when(n % 11 > 0, F.col("text")).alias("query"), n.cast("string").alias("limit"), F.when(n % 3 > 0, n % 2 == 0).alias("deep")))
    needs = F.when(F.col("needs") != F.col("call_id"), F.array("needs")).otherwise(F.array().cast("array<string>"))
    calls = calls.select("conv_id", "call_id", "turn", "name", F.when(n % 7 > 0, loose).otherwise(spoiled).alias("arguments"), needs.alias("depends_on"))
    users = turns.where("role = 'user' and turn > 0")
    results = users.select("conv_id", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return tool_links.linked(calls, results, SCHEMAS, workspace(spark))


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = simhash.near_duplicates(docs, workspace(spark))
    return rows.select(F.col("rest.doc_id").alias("doc_id"), simhash.fingerprint_text().alias("fingerprint"), F.col("component").alias("component_id"))


@query(
    "op4_vector_file",
    """
with whole as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5
""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 50 = 0"), workspace(spark))


@query("op5_sampled_splitters")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, folder, "documents"), workspace(spark))


@query("op6_factorisation_machine")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return factorisation.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_sum_of_squares")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_suffix_arrays")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.cut_repeats(table(spark, folder, "documents").select("doc_id", "text"), workspace(spark))
    return rows.select(
        F.col("rest.doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_pieces")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = pieces.encoded(docs, tokenizer("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        F.col("rest.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: The rules that op10 judges by.
RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


@query("op10_url_filter")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), RULES)


@query("op11_minhash")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), workspace(spark))
    key = F.col("rest.doc_id")
    return rows.select(key.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), key.eqNullSafe(F.col("component")).alias("kept"))


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows, _ = alignment.aligned(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), workspace(spark), digest=True)
    return rows.select(F.col("rest.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query(
    "op13_importance_resampling",
    """
with recursive bits as (
  select cast(range as bigint) as b, cast(range as bigint) as v, 0 as k from range(256)
  union all
  select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8
), step as (
  select b, v from bits where k = 8
), words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark
), features as (
  select kind, id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as f from words, (select unnest([1, 2, 3]) as k)
), kinds as (
  select f, hex(encode(f)) as x, strlen(f) as n from (select distinct f from features)
), positions as (
  select 1 as d, b, v from step
  union all
  select p.d + 1, p.b, xor(p.v // 256, s.v) from positions p join step s on s.b = p.v % 256 where p.d < (select max(n) from kinds)
), lengths as (
  select 0 as n, 4294967295 as v
  union all
  select l.n + 1, xor(l.v // 256, s.v) from lengths l join step s on s.b = l.v % 256 where l.n < (select max(n) from kinds)
), bytes as (
  select f, n, n - i as d, cast('0x' || x[2 * i + 1:2 * i + 2] as bigint) as b from (select f, x, n, unnest(range(n)) as i from kinds)
), hashed as (
  select f, xor(bit_xor(p.v), any_value(xor(l.v, 4294967295))) % 10000 as bucket
  from bytes y join positions p on p.d = y.d and p.b = y.b join lengths l on l.n = y.n group by f
), counted as (
  select bucket, count(*) filter (where kind = 'd') as s, count(*) filter (where kind = 'b') as t from features join hashed using (f) group by bucket
), totals as (
  select cast(coalesce(sum(s), 0) as double) as all_s, cast(coalesce(sum(t), 0) as double) as all_t from counted
), gains as (
  select bucket, cast(floor(1000 * ln((cast(t as double) + 1) * (all_s + 10000) / ((cast(s as double) + 1) * (all_t + 10000)))) as bigint) as gain from counted, totals
), weights as (
  select id, count(*) as n_features, cast(sum(gain) as bigint) as weight from features join hashed using (f) join gains using (bucket) where kind = 'd' group by id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(w.w) >= 20 as fit, coalesce(weight, 0)
    + cast(floor(-1000 * ln(-ln((cast(cast('0x' || left(sha256('42:' || doc_id), 8) as bigint) as double) + 0.5) / 4294967296))) as bigint) as score
  from documents d join words w on w.kind = 'd' and w.id = d.doc_id left join weights x on x.id = d.doc_id
), placed as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as place from scored
)
select doc_id, n_features, weight, score, case when fit and place <= 5 * (select count(*) from scored where fit) // 100 then place end as rank from placed
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = resampling.ranked(docs, table(spark, folder, "benchmark"), workspace(spark))
    return rows.select(F.col("rest.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")
