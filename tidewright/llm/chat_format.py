"""Chat formatting: tool calls joined to their results, ordered, validated and serialised; JVM expressions only.

A row of output is one message or one linked call, so a conversation of any length stays spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved

#: Tool to parameter to (type, required); types are string, integer, number, boolean, object, array.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}
BLOCK = 256
_PAYLOAD = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string,content:string>"


def calls_of(messages: DataFrame) -> DataFrame:
    """Calls in assistant messages whose text is JSON with ``tool_calls``: conv_id, turn, call_id, name, arguments,
    depends_on.  Arguments may be an object or its JSON text."""
    parsed = messages.filter((F.col("role") == "assistant") & F.ltrim("text").startswith("{"))
    parsed = parsed.withColumn("_p", F.from_json("text", _PAYLOAD))
    item = F.explode(F.col("_p.tool_calls")).alias("c")
    return parsed.select("conv_id", "turn", item).select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on")
    )


def results_of(messages: DataFrame) -> DataFrame:
    """Results in tool messages whose text is JSON with ``tool_call_id``: conv_id, turn, call_id, content."""
    parsed = messages.filter((F.col("role") == "tool") & F.ltrim("text").startswith("{"))
    p = F.from_json("text", _PAYLOAD)
    return parsed.select("conv_id", "turn", p.alias("_p")).select("conv_id", "turn", F.col("_p.tool_call_id").alias("call_id"), F.col("_p.content").alias("content")).filter("call_id is not null")


def valid_arguments(schemas: Schemas) -> Column:
    """Whether ``_args`` (variant) fits the schema of tool ``name``: an object, its required fields there, no unknown
    field, every type right; unknown tools and unreadable arguments do not fit."""
    fits = F.lit(False)
    keys = F.map_keys(F.from_json(F.to_json("_args"), "map<string,string>"))
    for tool, fields in schemas.items():
        ok = F.schema_of_variant("_args").rlike("^OBJECT")
        ok = ok & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in fields]).cast("array<string>"))) == 0)
        for key, (kind, required) in fields.items():
            path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
            found = F.schema_of_variant(F.try_variant_get("_args", path, "variant"))
            has = F.array_contains(keys, key)
            ok = ok & F.when(has, F.coalesce(found.rlike(_KINDS[kind]), F.lit(False))).otherwise(F.lit(not required))
        fits = F.when(F.col("name") == tool, ok).otherwise(fits)
    return F.coalesce(F.when(F.col("_args").isNull(), F.lit(False)).otherwise(fits), F.lit(False))


def _paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results with ``k``: the k-th call of a call_id and the result that answers it share it, first come,
    first served; a result that finds no call open before it has none.  Repeated equal calls are one."""
    loose = F.concat(F.lit("\x00"), F.expr("uuid()"))
    one = calls.distinct().select("conv_id", F.coalesce("call_id", loose).alias("call_id"), "turn", F.lit(False).alias("is_result"), "name", "arguments", "depends_on")
    rows = one.unionByName(results.withColumn("is_result", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_lone", F.when(F.col("conv_id").isNull(), F.expr("uuid()")))
    key = Window.partitionBy("conv_id", "_lone", "call_id").orderBy("turn", "is_result", "name", "arguments", F.to_json("depends_on"), "content")
    so_far = key.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum((~F.col("is_result")).cast("int")).over(so_far)).withColumn("_r", F.sum(F.col("is_result").cast("int")).over(so_far))
    rows = rows.withColumn("_over", F.greatest(F.lit(0), F.max(F.col("_r") - F.col("_c")).over(so_far)))
    early = F.col("_over") > F.lag("_over", 1, 0).over(key)
    k = F.when(~F.col("is_result"), F.col("_c")).when(~early, F.col("_r") - F.col("_over"))
    return rows.withColumn("k", k).drop("_c", "_r", "_over", "_lone")


def _ordered(calls: DataFrame) -> DataFrame:
    """Adds ``level`` and ``at``: calls in rounds, each after all it depends on; null level in a cycle or after one.

    at is the turn before which nothing of it can stand: the latest of its own and its dependencies' turns.
    Of a call_id used more than once the last call up to the own turn is meant, else the first.  Dependencies on
    unknown calls are ignored.
    """
    ids = ["conv_id", "call_id", "k"]
    edge = calls.select(*ids, "turn", F.explode("depends_on").alias("needs")).filter("needs <> call_id").distinct()
    loops = calls.filter(F.array_contains("depends_on", F.col("call_id"))).select(*ids).distinct()
    there = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("k").alias("nk"), F.col("turn").alias("nt"))
    before = F.max(F.when(F.col("nt") <= F.col("turn"), F.col("nk")))
    edge = edge.join(there, ["conv_id", "needs"]).groupBy(*ids, "needs").agg(F.coalesce(before, F.lit(1)).alias("nk"))
    if edge.isEmpty() and loops.isEmpty():
        return calls.withColumn("level", F.lit(0)).withColumn("at", F.col("turn"))
    edge = saved(edge, "needs")
    waiting = edge.select(*ids).union(loops).distinct()
    done = saved(calls.join(waiting, ids, "left_anti").select(*ids, F.lit(0).alias("level"), F.col("turn").alias("at")), "ordered")
    left = saved(calls.join(waiting, ids, "left_semi").join(loops, ids, "left_anti").select(*ids, "turn"), "waiting")
    level = 0
    while True:
        level += 1
        met = edge.join(done.select("conv_id", F.col("call_id").alias("needs"), F.col("k").alias("nk"), "at"), ["conv_id", "needs", "nk"], "left")
        ready = met.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("have"), F.max("at").alias("last")).filter("n = have")
        new = left.join(ready, ids).select(*ids, F.lit(level).alias("level"), F.greatest("turn", "last").alias("at"))
        new = saved(new, "ordered")
        if new.isEmpty():
            break
        done = saved(done.union(new), "ordered")
        left = saved(left.join(new, ids, "left_anti"), "waiting")
    out = calls.join(done, ids, "left")
    return out.withColumn("at", F.coalesce("at", "turn"))


def link_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Rows conv_id, pos, turn, kind (message, call, orphan), call_id, name, level, valid, status, result_turn, json.

    ``messages(conv_id, turn, role, text)`` are the plain ones; ``calls(conv_id, turn, call_id, name, arguments,
    depends_on)`` meet ``results(conv_id, turn, call_id, content)`` of their conversation by call_id, first come, first
    served; a result never answers a later call.  Only calls equal in all columns are one.  status: ok, invalid
    (arguments), unanswered, cycle, or orphan for a result without an open call before it.
    pos numbers a conversation's rows from 0: by turn, calls after all they depend on, each with its result.
    json has its keys in alphabetical order and no blanks; null fields are left out.  A row with a null conv_id is a
    conversation of its own; repeated messages stay; calls with a null call_id are never linked and stay.
    """
    events = saved(_paired(calls.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))), results), "events")
    unique = events.filter("not is_result").select("conv_id", "call_id", "k", "turn", "name", "arguments", "depends_on")
    told = events.filter("is_result").select("conv_id", "call_id", "k", F.struct("turn", "content").alias("r"))
    placed = _ordered(unique).withColumn("_there", F.lit(True))
    both = placed.join(told.filter("k is not null"), ["conv_id", "call_id", "k"], "left")
    both = both.unionByName(told.filter("k is null"), allowMissingColumns=True)
    both = both.withColumn("_args", F.try_parse_json("arguments"))
    shown = both.select(
        "conv_id",
        F.coalesce("at", "r.turn").alias("at"),
        F.coalesce("turn", "r.turn").alias("turn"),
        F.when(F.col("_there"), F.lit("call")).otherwise(F.lit("orphan")).alias("kind"),
        F.when(~F.col("call_id").startswith("\x00"), F.col("call_id")).alias("call_id"),
        "name",
        "level",
        F.when(F.col("_there"), valid_arguments(schemas)).alias("valid"),
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        "_args",
        "arguments",
    )
    status = (
        F.when(F.col("kind") == "orphan", F.lit("orphan"))
        .when(F.col("level").isNull(), F.lit("cycle"))
        .when(~F.col("valid"), F.lit("invalid"))
        .when(F.col("result_turn").isNull(), F.lit("unanswered"))
        .otherwise(F.lit("ok"))
    )
    raw = F.when(F.col("_args").isNull(), F.col("arguments"))
    body = F.to_json(F.struct(F.col("_args").alias("arguments"), raw.alias("arguments_text"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), F.lit("tool_call").alias("type")))
    shown = shown.withColumn("status", status).withColumn("json", body)
    plain = messages.select(
        "conv_id",
        F.col("turn").alias("at"),
        "turn",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"),
        F.lit(0).alias("level"),
        F.lit(None).cast("boolean").alias("valid"),
        F.lit(None).cast("long").alias("result_turn"),
        F.lit("ok").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("type"))).alias("json"),
    )
    rows = plain.unionByName(shown.select(plain.columns))
    rows = rows.withColumn("block", F.floor(F.coalesce("at", F.lit(-1)) / F.lit(BLOCK)))
    rows = saved(rows.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())), "rows")
    order = Window.partitionBy("conv_id", "lone", "block").orderBy(F.col("at").asc_nulls_first(), F.col("level").asc_nulls_last(), "kind", "call_id", "json")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.filter("conv_id is not null").groupBy("conv_id", "block").count()
    start = start.select("conv_id", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    out = rows.withColumn("n", F.row_number().over(order)).join(start, ["conv_id", "block"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return out.select("conv_id", (F.col("start") + F.col("n") - 1).cast("long").alias("pos"), "turn", "kind", "call_id", "name", "level", "valid", "status", "result_turn", "json")


#: The tool that stands for a plain question with the answer that follows it.
REPLY: Schemas = {"reply": {"prompt": ("string", True)}}


def format_chats(messages: DataFrame, schemas: Schemas = REPLY, pairs: bool = True) -> DataFrame:
    """``link_calls`` over a table of messages (conv_id, turn, role, text).

    JSON calls and results are taken out of assistant and tool messages.  With ``pairs``, each user turn is also
    a call of the tool ``reply`` whose result is the assistant message of the next turn, linked by the identifier
    ``conv_id:turn``; a user turn without text has no argument and is invalid.  All other messages stay plain;
    of repeated user turns the call keeps the least text and the others are plain.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls, results = calls_of(rows), results_of(rows)
    tool = F.from_json("text", _PAYLOAD)
    json_like = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    packed = F.coalesce(json_like & F.when(F.col("role") == "assistant", tool["tool_calls"].isNotNull()).when(F.col("role") == "tool", tool["tool_call_id"].isNotNull()), F.lit(False))
    plain = rows.filter(~packed)
    if pairs:
        ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
        numbered = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
        ask = plain.filter((F.col("role") == "user") & numbered).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
        tell = plain.filter((F.col("role") == "assistant") & numbered).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
        asked = ask.select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
        told = ask.select("conv_id", (F.col("turn") + 1).alias("turn")).join(tell, ["conv_id", "turn"]).select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
        calls, results = calls.unionByName(asked), results.unionByName(told)
        used = ask.select("conv_id", "turn", F.lit("user").alias("role"), "text").union(told.select("conv_id", "turn", F.lit("assistant"), "content")).withColumn("_used", F.lit(1))
        n = F.row_number().over(Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(1)))
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("conv_id", "turn", "role", "text")] + [F.col("p._n") == F.col("u._used")]
        plain = plain.withColumn("_n", n).alias("p").join(used.alias("u"), same, "left_anti").select("conv_id", "turn", "role", "text")
    schemas = {**REPLY, **schemas} if pairs else schemas
    return link_calls(plain, calls, results, schemas)
