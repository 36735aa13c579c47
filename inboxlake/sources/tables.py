"""The inbox tables: schemas, reading and snapshot writing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# table -> columns, as DDL
SCHEMAS = {
    "messages": "id bigint, brand string, channel string, conversation_id string, author string, author_id string, "
    "direction string, text string, text_pt string, category string, message_id string, created_at timestamp, "
    "deleted_at timestamp, hidden_at timestamp",
    "reply_queue": "id bigint, brand string, channel string, ref string, text string, origin string, "
    "created_at timestamp, sent_at timestamp, result string",
    "case_state": "id bigint, brand string, conversation_id string, author string, state string, given_email string, "
    "attempts int, context string, paused_until timestamp, pause_reason string, updated_at timestamp",
    "pauses": "conversation_id string, brand string, author string, reason string, paused_until timestamp",
    "purchases": "transaction string, email string, name string, product_id bigint, product_name string, "
    "status string, amount decimal(18,2), currency string, approved_ms bigint, registered_at timestamp, raw string",
    "items": "id bigint, brand string, title string, bucket string, file string, product_id bigint, "
    "unlocked_by array<bigint>, active boolean, section string, position int",
    "accesses": "event string, file string, email string, created_at timestamp",
    "refunds": "id bigint, brand string, channel string, author string, author_id string, email string, "
    "transactions array<string>, total decimal(18,2), currency string, reason string, reason_source string, "
    "requested_at timestamp, guided_at timestamp, note string, created_at timestamp",
    "purchase_checks": "brand string, conversation_id string, author string, email_checked string, origin string, "
    "result string, n_found int, action_taken string, decided_by string, approved boolean, api_response string, "
    "created_at timestamp",
    "pending_replies": "ref string, text string, created_at timestamp",
    "corrections": "id bigint, brand string, channel string, lang string, category string, question string, "
    "before string, instruction string, after string, is_rule boolean, rule string, created_at timestamp",
    "facts": "id bigint, topic string, text string, active boolean, updated_at timestamp, updated_by string",
    "deliveries": "id bigint, author_id string, brand string, lang string, to_address string, subject string, "
    "files array<string>, base string, result string, by_whom string, created_at timestamp",
    "summaries": "author_id string, brand string, summary string, wants string, next_step string, "
    "covers_until timestamp, n_msgs int, updated_at timestamp",
    "suggestions": "author_id string, brand string, channel string, lang string, mode string, instruction string, "
    "draft string, suggestion string, suggestion_pt string, model string, tokens_in bigint, tokens_out bigint, "
    "by_whom string, created_at timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of an inbox kept as parquet, with its declared schema (no inference pass)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """Write one version of a table beside the older ones, never over the files being read."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def workspace(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder for tables written between jobs, in ``folder`` or the one that the cluster shares.

    The shared folder is the session's ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``. Only
    a session in one process (``local[...]``) may go without either: it gets a temporary folder. A session on a
    cluster raises, as no folder of one machine can be read by the others.
    """
    shared = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="inboxlake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/inboxlake-{uuid.uuid4().hex}"


def settled(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as a table under a name of its own and read back: computed once, kept when executors are lost."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows with texts from which a step is made in slices, one more for each so many, and most slices.
SLICE_ROWS, SLICES = 100_000, 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def slices_for(texts: DataFrame) -> int:
    return min(SLICES, 1 + texts.count() // SLICE_ROWS)


def of_slice(key: str, k: int, n: int) -> Column:
    """Whether a row belongs to slice ``k`` of ``n`` by its ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == k


def dropping_shuffles(df: DataFrame, path: str) -> None:
    """Write ``df`` compressed, and drop what was shuffled for it when it is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def in_slices(build: Callable[[int], DataFrame], n: int, folder: str, name: str) -> DataFrame:
    """The rows of ``build(0)`` to ``build(n - 1)``, which are made and written one after another, so that what is shuffled for one of them is on disk at a time.

    For steps that must shuffle long texts: one slice is not written but returned as it is.
    """
    if n == 1:
        return build(0)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    for k in range(n):
        slice = build(k)
        dropping_shuffles(slice, f"{path}/slice={k}")
    return slice.sparkSession.read.schema(slice.schema).parquet(*[f"{path}/slice={k}" for k in range(n)])
