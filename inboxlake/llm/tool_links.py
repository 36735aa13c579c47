"""Tool calls and results of conversations: linked, ordered, checked against schemas and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlake.sources.tables import settled

#: JSON types a schema may ask for, and how they are told apart.
KINDS = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
}


_ALONE = re.compile("[\ud800-\udfff]")


def spelled(text: str) -> str:
    """Text that UTF-8 can hold: halves of surrogate pairs that stand alone are written as JSON escapes."""
    return _ALONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, without blanks, and with characters as they are, but for lone surrogates, which are escaped."""
    return spelled(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _no_constant(text: str):
    raise ValueError(text)


def parsed(text: str):
    """A JSON value. NaN, infinities and numbers beyond a double are no JSON here, and neither is what is nested too deeply to be written again: ValueError."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def problems(name: str | None, arguments: str | None, schemas: dict) -> tuple[list[str], object]:
    """What is wrong with a call's arguments, in sorted order, and the arguments parsed (null if they are no JSON).

    A schema is {field: (kind, required)}. Fields that it does not name are wrong too.
    """
    try:
        value = parsed(arguments) if arguments is not None else None
    except ValueError:
        return ["arguments are not JSON"], None
    if name not in schemas:
        return ["unknown tool"], value
    if not isinstance(value, dict):
        return ["arguments are not an object"], value
    schema, found = schemas[name], []
    for field, (kind, required) in schema.items():
        if field not in value:
            found += [f"{field} is missing"] * required
        elif not KINDS[kind](value[field]):
            found.append(f"{field} is not {kind}")
    found += [f"{field} is unknown" for field in value if field not in schema]
    return sorted(found), value


def levels(calls: DataFrame, folder: str) -> DataFrame:
    """(conv_id, call_id, level) of ``calls`` (conv_id, call_id, depends_on: array of call ids): topological order.

    Level 0 needs no other call of its conversation; any other level is one more than the greatest it needs. Ids that no call has are
    no dependencies. Calls on a cycle, and those that need one, have no row.

    Chains of calls that need one other each are contracted first, by doubling pointers, in as many rounds as the logarithm of the longest. What is
    left, calls that need several, is settled level by level by joins on the ids, and no conversation is gathered in one task.
    """
    ids = ["conv_id", "call_id"]
    own = calls.select(*ids)
    edges = calls.select(*ids, F.explode("depends_on").alias("needs")).distinct()
    known = own.select("conv_id", F.col("call_id").alias("needs"))
    edges = settled(edges.join(known, ["conv_id", "needs"], "left_semi"), folder, "edges")
    alone = edges.groupBy(*ids).agg(F.count("*").alias("many"), F.min("needs").alias("up")).where("many = 1")
    hops = settled(alone.select(*ids, "up", F.lit(1).cast("long").alias("d")), folder, "hops")
    first, most, reach = hops, hops.count(), 1
    while reach <= most:  # a pointer that still moves after that many steps goes round a cycle
        on = hops.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        moved = F.col("up2").isNotNull()
        jumped = hops.join(on, ["conv_id", "up"], "left").select(*ids, F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), moved.alias("moved"))
        jumped = settled(jumped, folder, "hops")
        hops, reach = jumped.drop("moved"), 2 * reach
        if jumped.where("moved").isEmpty():
            break
    inner = first.select("conv_id", F.col("call_id").alias("up"))
    hops = settled(hops.join(inner, ["conv_id", "up"], "left_anti"), folder, "hops")  # that ended at a call which needs none or several
    several = edges.join(first.select(*ids), ids, "left_anti")
    to = hops.select("conv_id", F.col("call_id").alias("needs"), "up", "d")
    weighed = several.join(to, ["conv_id", "needs"], "left").select(*ids, F.coalesce("up", "needs").alias("needs"), (F.coalesce("d", F.lit(0)) + 1).alias("d"))
    left = settled(weighed.groupBy(*ids, "needs").agg(F.max("d").alias("d")), folder, "edges")
    now = settled(own.join(edges.select(*ids).distinct(), ids, "left_anti").withColumn("level", F.lit(0).cast("long")), folder, "level")
    out, reached = now, None
    while not now.isEmpty():
        done = now.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("below"))
        hit = left.join(done, ["conv_id", "needs"]).select(*ids, (F.col("below") + F.col("d")).alias("level"))
        reached = settled(hit if reached is None else hit.union(reached), folder, "reached")
        left = settled(left.join(done, ["conv_id", "needs"], "left_anti"), folder, "edges")
        now = settled(reached.join(left, ids, "left_anti").groupBy(*ids).agg(F.max("level").alias("level")), folder, "level")
        reached = settled(reached.join(now, ids, "left_anti"), folder, "reached")
        out = out.union(now)
    out = settled(out, folder, "levels")
    tops = out.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("top"))
    chained = hops.join(tops, ["conv_id", "up"]).select(*ids, (F.col("top") + F.col("d")).alias("level"))
    return out.union(chained).withColumn("level", F.col("level").cast("int"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict, folder: str) -> DataFrame:
    """One row per call, and per result without one: conv_id, call_id, turn, level, status, valid, problems, line.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call ids). ``results``: conv_id, call_id, turn,
    content. Calls and results are joined by hash on (conv_id, call_id). Status: ``answered``, ``pending`` (no result),
    ``orphan`` (no call) or ``cycle`` (no place in the order). Of several calls or results with one id the first by turn,
    then by content (of calls: arguments, name, needs), counts; null ids match nothing, so such results are orphans and such calls pending. Order calls by (level, turn).
    ``line`` is the canonical JSON of the call, its arguments and its result. Other columns of the inputs are dropped, so no name can clash.

    Arguments that are no JSON (NaN and numbers beyond a double are none, nor is what is nested too deeply) are null and a problem; a lone surrogate is written as its
    escape. Arguments and contents may be of any length; a null or empty content is a result like any other; empty tables give no rows.
    """
    pick = ["conv_id", "call_id"]
    order = {True: ["turn", "content", "name", "depends_on"], False: ["turn", "content"]}
    calls = calls.select(*pick, "turn", "name", "arguments", "depends_on", F.col("arguments").alias("content"))
    results = results.select(*pick, "turn", "content")
    sound = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    single = lambda rows: rows.where(sound).withColumn("n", F.row_number().over(Window.partitionBy(*pick).orderBy(*order["name" in rows.columns]))).where("n = 1").drop("n")
    some = settled(single(calls).unionByName(calls.where(~sound)).drop("content"), folder, "calls")
    placed = levels(some.where(sound), folder)
    answers = single(results).unionByName(results.where(~sound)).select(*pick, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("has_result"))
    asked = some.join(placed, pick, "left").withColumn("has_call", F.lit(True))
    rows = asked.join(answers.hint("shuffle_hash"), pick, "full").select(
        *pick, F.coalesce("turn", "result_turn").alias("turn"), "level", "name", "arguments", "content",
        F.coalesce("has_call", F.lit(False)).alias("has_call"), F.coalesce("has_result", F.lit(False)).alias("has_result"),
        (F.col("has_call") & F.col("level").isNull() & sound).alias("cycle"),
    )
    status = F.when(~F.col("has_call"), "orphan").when(F.col("cycle"), "cycle").when(F.col("has_result"), "answered").otherwise("pending")
    rows = rows.select(*pick, "turn", "level", "name", "arguments", "content", status.alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong, lines = [], []
            for row in batch.select(["call_id", "name", "arguments", "content", "status"]).to_pylist():
                found, value = ([], None) if row["status"] == "orphan" else problems(row["name"], row["arguments"], schemas)
                wrong.append(found)
                lines.append(canonical({"arguments": value, "call_id": row["call_id"], "name": row["name"], "result": row["content"]}))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "call_id", "turn", "level", "status")),
                    pa.array([not x for x in wrong], pa.bool_()),
                    pa.array([spelled("; ".join(x)) for x in wrong], pa.string()),
                    pa.array(lines, pa.string()),
                ],
                names=["conv_id", "call_id", "turn", "level", "status", "valid", "problems", "line"],
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "call_id", "turn")}
    fields = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return rows.mapInArrow(run, f"{fields}, level int, status string, valid boolean, problems string, line string")
