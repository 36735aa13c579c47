"""Cases that are not resolved, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.constants import INBOUND, OUTBOUND, PAID_STATUSES
from inboxlake.functions.text import blank_to_null, elapsed, instant
from inboxlake.operators.skew import HOT_ROWS, skew_join


def open_cases(case_state: DataFrame) -> DataFrame:
    """Every state but the resolved one; a missing state is open."""
    return case_state.filter(~F.col("state").eqNullSafe("resolvido"))


def of_cases(cases: DataFrame, messages: DataFrame, reply_queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages and replies of the conversations of ``cases``, selected before anything is aggregated."""
    ids = cases.select("conversation_id").distinct()
    spoken = messages.join(ids.withColumnRenamed("conversation_id", "author_id"), "author_id", "left_semi")
    return spoken, reply_queue.join(ids.withColumnRenamed("conversation_id", "ref"), "ref", "left_semi")


def conversation_facts(messages: DataFrame, reply_queue: DataFrame) -> DataFrame:
    """One row per author or reply ref: known name, newest inbound and outbound, unsent reply.

    No brand or channel is compared. Both tables go into one aggregation, so a
    case needs one join.
    """
    spoken = messages.select(
        F.col("author_id").alias("conversation_id"),
        blank_to_null(F.col("author")).alias("name"),
        F.when(F.col("direction") == INBOUND, F.col("created_at")).alias("inbound_at"),
        F.when(F.col("direction") == OUTBOUND, F.col("created_at")).alias("outbound_at"),
    )
    replies = reply_queue.select(
        F.col("ref").alias("conversation_id"),
        F.col("sent_at").alias("outbound_at"),
        F.when(F.col("sent_at").isNull(), True).alias("unsent"),
    )
    both = spoken.unionByName(replies, allowMissingColumns=True).filter(F.col("conversation_id").isNotNull())
    return both.groupBy("conversation_id").agg(
        F.max("name").alias("known_name"),
        F.max("inbound_at").alias("last_in"),
        F.max("outbound_at").alias("last_out"),
        F.max("unsent").alias("reply_queued"),
    )


def paid_emails(purchases: DataFrame) -> DataFrame:
    """Every e-mail, lower case, with a paid purchase."""
    paid = purchases.filter(F.col("status").isin(*PAID_STATUSES) & F.col("email").isNotNull())
    return paid.select(F.lower("email").alias("email_key")).distinct()


def with_conversation_facts(
    cases: DataFrame, facts: DataFrame, counted: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    joined = skew_join(cases, facts, ["conversation_id"], "left", spread=["id"], counted=counted, hot_rows=hot_rows)
    return (
        joined.withColumn("author", F.coalesce(blank_to_null(F.col("author")), F.col("known_name")))
        .withColumn("reply_queued", F.coalesce("reply_queued", F.lit(False)))
        .drop("known_name")
    )


def with_paid_flag(cases: DataFrame, purchases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whether the e-mail given in the case has a paid purchase, in any letter case."""
    keyed = cases.withColumn("email_key", F.lower(blank_to_null(F.col("given_email"))))
    flags = paid_emails(purchases).withColumn("has_purchase", F.lit(True))
    joined = skew_join(keyed, flags, ["email_key"], "left", spread=["id"], hot_rows=hot_rows)
    return joined.withColumn("has_purchase", F.coalesce("has_purchase", F.lit(False))).drop("email_key")


def stuck_cases(
    case_state: DataFrame, messages: DataFrame, reply_queue: DataFrame, purchases: DataFrame, as_of
) -> DataFrame:
    """The report, oldest update first."""
    cases = with_paid_flag(open_cases(case_state), purchases)
    cases = with_conversation_facts(cases, conversation_facts(*of_cases(open_cases(case_state), messages, reply_queue)), counted=case_state)
    now = instant(as_of)
    return cases.select(
        now.alias("as_of"),
        "id",
        "author",
        "conversation_id",
        "brand",
        "state",
        "given_email",
        "attempts",
        "updated_at",
        "paused_until",
        "pause_reason",
        "last_in",
        "last_out",
        elapsed(now, F.col("updated_at"), 86400).alias("days_idle"),
        "has_purchase",
        "reply_queued",
    ).orderBy(F.col("updated_at").asc_nulls_last(), "id")
