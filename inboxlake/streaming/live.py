"""Streaming forms of the thread queue and of the reply outbox, on Spark's own stream joins and on tables in buckets.

``start_lookup`` joins comments with the sends to them and appends sends with their author. ``start_threads`` keeps what a thread said on
each day, split over a few salts so that a hot thread is many small rows, in a table of which each batch rewrites the buckets it touches; parts
are merged when the queue is read, with the clock given then. ``start_outbox`` checks replies; which comments exist is the state of a
stream join, so no batch reads earlier input again. Nothing runs once a key: events of a batch are aggregated, joined and written by Spark.

The state store is RocksDB, which the functions here set for the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inboxlake.constants import INBOUND, OUTBOUND
from inboxlake.functions.language import bound
from inboxlake.functions.text import blank_to_null, instant, is_blank
from inboxlake.operators import actions
from inboxlake.operators.threads import THREAD, never
from inboxlake.sources import snapshots
from inboxlake.sources.tables import settled

DAYS = 7
RESOLVED = "author_id string, brand string, channel string, sent_at timestamp"
#: Parts that one thread's day is split into.
SALTS = 8
PART = [*THREAD, "day", "salt"]
#: Buckets of parts go by day, as a batch has events of few days: parts of other days are not written again.
BUCKET = ["day"]
#: A part of a thread: newest outbound message and send, names with the time they were last seen, the newest inbound, and all inbound
#: messages that the part does not know to be answered.
PARTS = (
    "author_id string, brand string, channel string, day bigint, salt int, out bigint, sent bigint, names array<struct<name: string, at: bigint>>, "
    "last struct<at: bigint, id: bigint, message_id: string>, open array<struct<at: bigint, id: bigint, media: boolean, category: string, batch: bigint>>"
)
#: What a batch read, kept in ``folder/events``: the texts stay there and are not written again with the parts.
EVENTS = (
    "author_id string, brand string, channel string, at timestamp, id bigint, name string, text string, kind string, media boolean, category string, "
    "message_id string, micros bigint, day bigint, salt int"
)
#: A reply window that has closed: after so many hours nothing newer had come in.
CLOCKS = "author_id string, brand string, channel string, last_in timestamp, hours int"
DAY, HOUR = 86_400_000_000, 3_600_000_000
HOURS = (24, 168)


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- the author of a comment --------------------------------------------------


def resolved_sends(messages: DataFrame, reply_queue: DataFrame, late: str, keep_days: int | None) -> DataFrame:
    """Sent replies to comments with the author of the comment, whichever of the two arrives first. With ``keep_days`` one may arrive ``late`` after newer events."""
    known = messages.filter(F.col("message_id").isNotNull() & F.col("author_id").isNotNull() & F.col("created_at").isNotNull())
    known = known.select("message_id", "author_id", F.col("created_at").alias("said_at"))
    sent = reply_queue.filter(F.col("sent_at").isNotNull() & (F.col("channel") != "dm") & F.col("ref").isNotNull())
    sent = sent.select("ref", "brand", "sent_at")
    same = F.col("message_id") == F.col("ref")
    if keep_days is None:  # a comment that comes again is no new one
        known = known.dropDuplicates(["message_id", "author_id"])
    else:
        known, sent = known.withWatermark("said_at", late), sent.withWatermark("sent_at", late)
        kept = F.expr(f"interval {keep_days} days")
        same = same & (F.col("sent_at") <= F.col("said_at") + kept) & (F.col("said_at") <= F.col("sent_at") + kept)
    return known.join(sent, same).select("author_id", "brand", F.lit("comentario").alias("channel"), "sent_at")


def start_lookup(messages: DataFrame, reply_queue: DataFrame, folder: str, late: str = "30 days", keep_days: int | None = None, **trigger) -> StreamingQuery:
    """Append the sends to comments with their author to ``folder/resolved``, whichever of the two arrives first.

    Authors are kept for good, on disk; with ``keep_days`` a send more than so many days of event time after its comment finds no author, which the
    batch queue would, and state ends by the watermark.
    """
    _stateful(messages.sparkSession)
    rows = resolved_sends(messages, reply_queue, late, keep_days)
    sink = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/resolved")
    return sink.option("checkpointLocation", f"{folder}/lookup-progress").trigger(**trigger).start()


# --- threads ------------------------------------------------------------------


def thread_events(messages: DataFrame, reply_queue: DataFrame, resolved: DataFrame, salts: int) -> DataFrame:
    """Messages with an author, sent direct replies and resolved sends, by thread, day and salt."""
    inbound = F.col("direction") == INBOUND
    spoken = messages.filter(~is_blank(F.col("author_id")) & F.col("created_at").isNotNull()).select(
        *THREAD, F.col("created_at").alias("at"), "id", blank_to_null(F.col("author")).alias("name"), F.when(inbound, F.col("text")).alias("text"),
        F.when(inbound, "in").when(F.col("direction") == OUTBOUND, "out").otherwise("other").alias("kind"), is_blank(F.col("text")).alias("media"),
        "category", "message_id",
    )
    direct = reply_queue.filter(F.col("sent_at").isNotNull() & (F.col("channel") == "dm"))
    direct = direct.select(F.col("ref").alias("author_id"), "brand", "channel", F.col("sent_at").alias("at"), F.lit("send").alias("kind"))
    others = resolved.select(*THREAD, F.col("sent_at").alias("at"), F.lit("send").alias("kind"))
    events = spoken
    for sends in (direct, others):
        events = events.unionByName(sends, allowMissingColumns=True)
    micros = F.unix_micros("at")
    events = events.withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    return events.select("*", micros.alias("micros"), F.floor(micros / DAY).alias("day"), F.pmod(F.xxhash64("id", micros), F.lit(salts)).cast("int").alias("salt"))


def _said(events: DataFrame, batch: int) -> DataFrame:
    """The parts that the events of a batch make, without texts."""
    kind, at = F.col("kind"), F.col("micros")
    inbound = kind == "in"
    parts = events.groupBy(*PART).agg(
        F.max(F.when(kind == "out", at)).alias("out"),
        F.max(F.when(kind == "send", at)).alias("sent"),
        F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", at.alias("at")))).alias("names"),
        F.max(F.when(inbound, F.struct(at.alias("at"), "id", "message_id"))).alias("last"),
        F.collect_list(F.when(inbound, F.struct(at.alias("at"), "id", "media", "category", F.lit(batch).cast("long").alias("batch")))).alias("open"),
    )
    return parts.withColumn("names", _newest_names(F.col("names")))


def _newest_names(names: Column) -> Column:
    """Each name once, with the last time it was seen."""
    last = lambda ordered: lambda x, i: F.coalesce(F.get(ordered, i + 1)["name"] != x["name"], F.lit(True))
    return bound(F.array_sort(names), lambda ordered: F.filter(ordered, last(ordered)))


def _merged(old: DataFrame, new: DataFrame, batch: int) -> DataFrame:
    """Old and new parts as one each. What an interrupted run of the same batch left in the old ones is not counted twice."""
    before = old.select(*new.columns).withColumn("open", F.filter("open", lambda x: x["batch"] != batch))
    both = before.unionByName(new).groupBy(*PART).agg(
        F.max("out").alias("out"),
        F.max("sent").alias("sent"),
        F.flatten(F.collect_list("names")).alias("names"),
        F.max("last").alias("last"),
        F.flatten(F.collect_list("open")).alias("open"),
    )
    answered = F.coalesce(F.greatest("out", "sent"), F.lit(0).cast("long"))
    both = both.withColumn("answered", answered)
    return both.withColumn("names", _newest_names(F.col("names"))).withColumn("open", F.filter("open", lambda x: x["at"] > F.col("answered"))).drop("answered")


def start_threads(messages: DataFrame, reply_queue: DataFrame, folder: str, days: int = DAYS, late: str = "30 days", salts: int = SALTS, **trigger) -> StreamingQuery:
    """Keep ``folder/threads``, a table of the parts of all threads of which each batch rewrites only the buckets it touches, and ``folder/clocks``.

    ``folder/resolved`` is what ``start_lookup`` appends. The clock of the stream is the newest event less ``late``. A part is emptied ``days`` after its day ended by
    that clock, and later events of its day count no more; newest sends stay. The clock also tells when the reply windows of 24 and 168 hours close
    (``closed_windows``). ``folder/events`` keeps what each batch read, with the texts. A repeated batch writes the same rows again.
    """
    spark = messages.sparkSession
    resolved = spark.readStream.schema(RESOLVED).parquet(f"{folder}/resolved")
    events = thread_events(messages, reply_queue, resolved, salts)
    path, schema = f"{folder}/threads", f"{PARTS}, days int"
    names = spark.createDataFrame([], schema).columns

    columns = spark.createDataFrame([], EVENTS).columns

    def clock(newest: DataFrame) -> int | None:
        return newest.select(F.unix_micros(F.timestamp_micros(F.max("newest")) - F.expr(f"interval {late}"))).first()[0]

    def run(rows: DataFrame, batch: int) -> None:
        rows.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/events/batch={batch}")
        read = spark.read.schema(EVENTS).parquet(f"{folder}/events/batch={batch}")
        seen = [spark.read.schema("newest bigint").parquet(f"{folder}/newest/batch={k}") for k in (batch - 1,) if k >= 0]
        before = clock(seen[0]) if seen else None
        newest = read.agg(F.max("micros").alias("newest"))
        for earlier in seen:
            newest = newest.unionByName(earlier).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{folder}/newest/batch={batch}")
        now = clock(spark.read.schema("newest bigint").parquet(f"{folder}/newest/batch={batch}"))
        if now is None:
            return  # no event yet
        over = (F.col("day") + 1 + days) * F.lit(DAY) <= F.lit(now)
        new = settled(_said(read, batch), f"{folder}/steps", "said")
        old = snapshots.read(spark, path, schema)
        # windows that the clock has passed since the last batch, and those of newest messages that were late
        ends = F.col("last.at") + F.col("hours") * F.lit(HOUR)
        passed = F.lit(before).cast("long")
        held = old.select(*THREAD, "last", F.lit(False).alias("is_new")).unionByName(new.select(*THREAD, "last", F.lit(True).alias("is_new")))
        held = held.where("last is not null").withColumn("hours", F.explode(F.array(*map(F.lit, HOURS))))
        closed = held.where((ends <= F.lit(now)) & (F.col("is_new") | passed.isNull() | (ends > passed)))
        # a repeated batch finds parts emptied that it told about before, so it adds to what is there
        closed.select(*THREAD, F.timestamp_micros("last.at").alias("last_in"), "hours").distinct().write.mode("append").parquet(f"{folder}/clocks/batch={batch}")

        def apply(held: DataFrame) -> DataFrame:
            parts = _merged(held, new, batch).withColumn("over", over)
            for c in ("names", "open"):
                parts = parts.withColumn(c, F.when(F.col("over"), F.slice(c, 1, 0)).otherwise(F.col(c)))
            parts = parts.withColumn("last", F.when(~F.col("over"), F.col("last"))).withColumn("days", F.lit(days)).select(*names)
            return parts.where(F.col("sent").isNotNull() | F.col("last").isNotNull() | (F.size("names") > 0) | F.col("out").isNotNull())

        ended = old.where(over & ((F.size("open") > 0) | (F.size("names") > 0) | F.col("last").isNotNull()))
        snapshots.update(spark, path, schema, BUCKET, new.select(*BUCKET).unionByName(ended.select(*BUCKET)), apply, f"{folder}/steps")

    try:
        snapshots.create(spark.createDataFrame([], schema), path, BUCKET)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    for name, kind in (("events", EVENTS), ("clocks", CLOCKS)):  # readers find an empty table before the first batch
        spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")
    sink = events.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", f"{folder}/threads-progress")
    return sink.trigger(**trigger).start()


def _same_thread(a: str, b: str) -> Column:
    both = F.lit(True)
    for c in THREAD:
        both = both & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return both


def current_threads(spark: SparkSession, folder: str, as_of, days: int = DAYS) -> DataFrame:
    """The threads that wait at ``as_of``, merged from their parts. Raises if the stream kept a shorter window than ``days``."""
    parts = snapshots.read(spark, f"{folder}/threads", f"{PARTS}, days int")
    kept = parts.agg(F.min("days")).first()[0]
    if kept is not None and days > kept:
        raise ValueError(f"the stream keeps {kept} days; {days} were asked for")
    start = F.unix_micros(instant(as_of)) - max(days, 1) * DAY
    matched = F.col("brand").isNotNull() & F.col("channel").isNotNull()
    threads = parts.groupBy(*THREAD).agg(
        F.max(F.array_max(F.transform(F.filter("names", lambda x: x["at"] >= start), lambda x: x["name"]))).alias("author"),
        F.max(F.when(F.col("last.at") >= start, F.col("last.at"))).alias("last_in"),
        F.greatest(F.max(F.when(F.col("out") >= start, F.col("out"))), F.max(F.when(matched, F.col("sent"))), F.unix_micros(never())).alias("last_out"),
    )
    threads = threads.filter(F.col("last_in") > F.col("last_out"))
    inside = parts.where((F.size("open") > 0) | (F.col("last.at") >= start)).alias("p").join(threads.alias("t"), _same_thread("p", "t"))
    waits = F.filter("open", lambda x: (x["at"] >= start) & (x["at"] > F.col("last_out")))
    rows = inside.select(*[F.col(f"t.{c}").alias(c) for c in THREAD], "author", "last_in", "last_out", waits.alias("open"), "last")
    categories = F.array_distinct(F.filter(F.transform("open", lambda x: x["category"]), lambda c: c.isNotNull()))
    merged = rows.groupBy(*THREAD, "author", "last_in", "last_out").agg(
        F.min(F.array_min(F.transform("open", lambda x: x["at"]))).alias("since"),
        F.sum(F.size("open")).alias("n"),
        F.sum(F.size(F.filter("open", lambda x: x["media"]))).alias("media"),
        F.max_by("last", F.struct("last.at", "last.id")).alias("last"),
        F.array_distinct(F.flatten(F.collect_set(categories))).alias("categories"),  # as many as there are different ones
    )
    # the texts of the newest messages only are fetched; where nobody asks for them, no text is read
    said = spark.read.schema(f"{EVENTS}, batch bigint").parquet(f"{folder}/events").where((F.col("kind") == "in") & (F.col("micros") >= start))
    texts = said.select(*THREAD, F.col("micros").alias("at"), "id", "message_id", "text").alias("x")
    wanted = merged.select(*THREAD, "last").alias("m")
    named = (F.col("x.id") == F.col("m.last.id")) & (F.col("x.at") == F.col("m.last.at")) & F.col("x.message_id").eqNullSafe(F.col("m.last.message_id"))
    found = wanted.join(texts, named & _same_thread("x", "m")).groupBy(*[F.col(f"m.{c}").alias(c) for c in THREAD]).agg(F.max("x.text").alias("last_text"))
    merged = merged.alias("t").join(found.alias("f"), _same_thread("t", "f"), "left").select("t.*", "f.last_text")
    none = F.lit(0).cast("long")
    return merged.select(
        *THREAD,
        "author",
        F.timestamp_micros("last_in").alias("last_in"),
        F.timestamp_micros("last_out").alias("last_out"),
        F.when(matched, F.timestamp_micros("since")).alias("waiting_since"),
        F.when(matched, F.col("n")).otherwise(none).alias("n_unanswered"),
        F.when(matched, F.col("media")).otherwise(none).alias("n_media"),
        F.when(matched, blank_to_null(F.array_join(F.array_sort("categories"), ", "))).alias("categories"),
        F.when(matched, F.col("last_text")).alias("last_text"),
        F.when(matched, F.col("last.message_id")).alias("last_message_id"),
    )


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """(thread, last_in, hours): reply windows that closed by the watermark with nothing newer come in, over all parts of the thread."""
    clocks = spark.read.schema(CLOCKS).parquet(f"{folder}/clocks").distinct()
    newest = clocks.groupBy(*THREAD).agg(F.max("last_in").alias("newest"))
    parts = snapshots.read(spark, f"{folder}/threads", f"{PARTS}, days int").groupBy(*THREAD).agg(F.max(F.timestamp_micros("last.at")).alias("held"))
    known = clocks.alias("c").join(newest.alias("n"), _same_thread("c", "n")).where("c.last_in = n.newest").select("c.*")
    joined = known.alias("c").join(parts.alias("p"), _same_thread("c", "p"), "left")
    return joined.where("p.held is null or p.held <= c.last_in").select("c.*")


# --- outbox -------------------------------------------------------------------

ACCEPTED = "seq bigint, brand string, channel string, ref string, text string, by_whom string"
#: What a batch read, kept in ``folder/changes``: replies with what they break if their comment is there (``error``) and if it is not (``missing``), and the
#: replies whose comment has come (``known``). ``version`` tells rows of one ``seq`` apart.
CHANGES = f"{ACCEPTED}, known boolean, version bigint, error string, missing string"
#: For each ``seq`` the row of ``folder/changes`` that counts, and whether its comment is known.
CHECKED = "seq bigint, ref string, batch bigint, version bigint, known boolean"


def start_outbox(replies: DataFrame, messages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Check reply actions against the comments seen so far and keep ``folder/checked``, one row for each ``seq``.

    Both arguments are streams; a stream join of ids keeps comments and the replies to them. A reply that comes before its comment is rejected, and counts
    when the comment arrives. Texts are checked as they are read and written once, to ``folder/changes``; each batch rewrites the buckets of its ``seq``
    only, which hold no texts.
    """
    spark = replies.sparkSession
    _stateful(spark)
    comments = messages.filter((F.col("channel") == "comentario") & F.col("message_id").isNotNull()).select("message_id").dropDuplicates(["message_id"])
    # the join has ids only; it tells once that a reply's comment is there, in the batch of the later of the two
    waiting = replies.filter((F.col("channel") != "dm") & F.col("ref").isNotNull()).select("seq", "ref")
    found = waiting.join(comments, F.col("ref") == F.col("message_id")).select("seq", "ref", F.lit(True).alias("known"))
    names = spark.createDataFrame([], ACCEPTED).columns
    asked = replies.select(*names, F.lit(False).alias("known"), F.xxhash64(*names).alias("version"))
    asked = actions.with_error(asked, F.lit(False)).withColumnRenamed("error", "missing")
    asked = actions.with_error(asked, F.lit(True)).select(*spark.createDataFrame([], CHANGES).columns)
    told = asked.unionByName(found, allowMissingColumns=True)
    path = f"{folder}/checked"

    def run(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/changes/batch={batch}")
        told = spark.read.schema(CHANGES).parquet(f"{folder}/changes/batch={batch}")
        found = told.where("known").select("seq", "ref", F.lit(True).alias("now")).distinct()
        new = told.where("not known").groupBy("seq").agg(F.max(F.struct("version", "ref")).alias("x"))
        new = new.select("seq", "x.ref", F.lit(batch).cast("long").alias("batch"), "x.version", F.lit(False).alias("known"))

        def apply(old: DataFrame) -> DataFrame:
            # replies of this batch, and earlier ones, whose comment may have come now
            rows = old.join(new.select("seq"), "seq", "left_anti").unionByName(new).join(found, ["seq", "ref"], "left")
            return rows.withColumn("known", F.col("known") | F.coalesce("now", F.lit(False))).drop("now").select(*old.columns)

        snapshots.update(spark, path, CHECKED, ["seq"], told.select("seq"), apply, f"{folder}/steps")

    try:
        snapshots.create(spark.createDataFrame([], CHECKED), path, ["seq"])
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    spark.createDataFrame([], CHANGES).write.mode("ignore").parquet(f"{folder}/changes/batch=-1")  # readers find an empty table before the first batch
    return told.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", f"{folder}/outbox-progress").trigger(**trigger).start()


def outbox_actions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) actions so far. Texts come from what the batches read, those of replies that no comment can mend left out of the accepted ones."""
    checked, names = snapshots.read(spark, f"{folder}/checked", CHECKED), spark.createDataFrame([], ACCEPTED).columns
    key = ["seq", "batch", "version"]

    def of(read: DataFrame) -> DataFrame:
        rows = read.drop("ref", "known").join(checked, key).withColumn("error", F.when(F.col("known"), F.col("error")).otherwise(F.col("missing")))
        return rows.dropDuplicates(key).select(*names, "error")  # equal rows of one batch are one

    said = spark.read.schema(f"{CHANGES}, batch bigint").parquet(f"{folder}/changes").where("not known")
    return actions.split_valid(of(said.where("error is null")))[0], actions.split_valid(of(said))[1]


def current_outbox(spark: SparkSession, folder: str, reply_queue: DataFrame, as_of, first_id: int) -> DataFrame:
    """The reply queue with every accepted action so far: one row per (channel, ref), whatever batch it came in."""
    accepted = settled(outbox_actions(spark, folder)[0], f"{folder}/steps", "accepted")  # needed more than once
    return actions.upsert_replies(reply_queue, accepted, as_of, first_id)
