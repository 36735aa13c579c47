"""Queries that run the streaming forms to the end of their input."""

from __future__ import annotations

from inboxlake.operators.threads import THREAD
from inboxlake.plans.actions import CHECKED, FIRST_ID
from inboxlake.plans.registry import ORACLES, query
from inboxlake.plans.threads import KEYS, WAITING
from inboxlake.sources.derived import AS_OF, Streams
from inboxlake.sources.tables import workspace
from inboxlake.streaming import live

#: Micro-batches of a table, and files that a batch reads (and tasks that write them).
FILES, TASKS = 4, 8


def streams(t, folder: str, **orders: str) -> Streams:
    """The tables as streams, which come in the order of a column each."""
    return Streams(t.spark, t.folder, f"{folder}/in", orders, FILES * TASKS, TASKS)


@query("S01_live_threads", WAITING + f" select {KEYS}, author, last_in, last_out, waiting_since, n_unanswered, n_media, categories, last_message_id from waiting")
def _(t):
    folder = workspace(t.spark)
    said = streams(t, folder, events="ts", conversations="-(conv_id % 40)", customer="-(c_custkey % 240)")
    live.start_lookup(said.messages, said.reply_queue, folder, availableNow=True).awaitTermination()
    live.start_threads(said.messages, said.reply_queue, folder, availableNow=True).awaitTermination()
    return live.current_threads(t.spark, folder, AS_OF).select(
        *THREAD, "author", "last_in", "last_out", "waiting_since", "n_unanswered", "n_media", "categories", "last_message_id"
    )


def _outbox(t) -> str:
    folder = workspace(t.spark)
    said = streams(t, folder, events="event_id", conversations="conv_id")
    live.start_outbox(said.actions_reply, said.messages, folder, availableNow=True).awaitTermination()
    return folder


@query("S02_outbox", ORACLES["E02_reply_upsert"])
def _(t):
    return live.current_outbox(t.spark, _outbox(t), t.reply_queue, AS_OF, FIRST_ID)


@query("S02_outbox_rejected", CHECKED + " select seq, error from checked where error is not null")
def _(t):
    return live.outbox_actions(t.spark, _outbox(t))[1].select("seq", "error")
