"""Tool-call linking in conversations: calls and results joined by identifier, ordered, validated, and written as canonical JSON.

A turn's text is a message, unless it is a JSON object with `tool_calls` (a list of {id, name, arguments}, or of {id, type, function:
{name, arguments}}) or with `tool_call_id` (and content): then it holds calls, or the result of a call. A call depends on the calls whose ids its arguments
name as ${id}.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import discard, materialize
from .prefix import running

def _flat(required: tuple[str, ...] = (), **kinds: str) -> dict:
    return {"type": "object", "required": list(required), "properties": {k: {"type": v} for k, v in kinds.items()}}


#: Tools by name, each with a schema: type, required, properties, items, enum and additionalProperties as in JSON Schema, but that
#: properties not named are faults unless additionalProperties is true.
SCHEMAS = {
    "search": _flat(("query",), query="string", limit="integer"),
    "calculator": _flat(("expression",), expression="string"),
    "get_weather": _flat(("city",), city="string", unit="string"),
    "run_code": _flat(("code",), code="string", timeout="number"),
}
_TURN = "tool_calls array<string>, tool_call_id string, content string"
_CALL = "id string, name string, arguments string, function struct<name:string,arguments:string>"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def schemas_of(table: DataFrame) -> dict:
    """The schemas of a table of tools (name, schema as JSON text); a row a tool. The last of a name in the order of the texts counts."""
    return {r["name"]: json.loads(r["schema"]) for r in table.select("name", "schema").orderBy("name", "schema").collect()}


def _refused(name: str):
    raise ValueError(f"{name} is not JSON")


def _loads(text: str):
    return json.loads(text, parse_constant=_refused)


def _writable(text: str) -> str:
    """text with unpaired surrogates as escapes, for they have no bytes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys, no white space and no escapes but the needed ones; null where the text isn't JSON (NaN, infinities and
    numbers beyond a double aren't)."""
    try:
        return None if text is None else _writable(json.dumps(_loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """canonical() of each text."""
    return text.map(canonical)


def _other_fields(text: str | None) -> str | None:
    """The fields of a call but its id, name and arguments, those of its function too, as canonical JSON; null if there are none."""
    try:
        call = _loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(call, dict):
        return None
    named = call.get("function")
    rest = {k: v for k, v in call.items() if k not in ("id", "function", *(("name", "arguments") if not isinstance(named, dict) else ()))}
    if isinstance(named, dict):
        own = {k: v for k, v in named.items() if k not in ("name", "arguments")}
        rest |= {"function": own} if own else {}
        rest.pop("type", None) if rest.get("type") == "function" else None
    elif named is not None:
        rest["function"] = named
    return canonical(json.dumps(rest)) if rest else None


@F.pandas_udf(StringType())
def other_fields(text: pd.Series) -> pd.Series:
    return text.map(_other_fields).astype(object)


def fault_of(value, schema: dict, at: str = "") -> str | None:
    """The first fault of a value by its schema, or null: a wrong type, a value outside enum, missing or unknown properties."""
    kind = schema.get("type")
    if kind is not None:
        kinds = [kind] if isinstance(kind, str) else kind
        if not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
            return f"{at or 'arguments'} is not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at or 'arguments'} is not one of its values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for p in sorted(set(known) | set(schema.get("required", ()))):
            name = f"{at}.{p}" if at else p
            if p not in value:
                if p in schema.get("required", ()):
                    return f"missing {name}"
            elif found := fault_of(value[p], known.get(p, {}), name):
                return found
        if known and schema.get("additionalProperties") is not True:
            for p in sorted(set(value) - set(known)):
                return f"unknown parameter {f'{at}.{p}' if at else p}"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if found := fault_of(x, schema["items"], f"{at}[{k}]"):
                return found
    return None


def validator(schemas: dict):
    """A UDF (name, arguments) -> the first fault found, or null: unknown tool, not JSON, not an object, or fault_of()."""

    @F.pandas_udf(StringType())
    def fault(name: pd.Series, arguments: pd.Series) -> pd.Series:
        def one(n, a):
            if n not in schemas:
                return "unknown tool"
            try:
                got = _loads(a if a is not None else "{}")
                if not isinstance(got, dict):
                    return "arguments are not an object"
                found = fault_of(got, schemas[n])
            except (ValueError, RecursionError):
                return "arguments are not JSON"
            return None if found is None else _writable(found)

        return pd.Series([one(n, a) for n, a in zip(name, arguments)], dtype=object)

    return fault


def events(turns: DataFrame) -> DataFrame:
    """conv_id, turn, idx, kind (message, call, result), role, id, name, body, extra: an event for each message, call and result. extra: a
    call's other fields, as JSON; `type` is not among them if it says that the call is of a function.

    Text beside a turn's calls is an event before them: a result if the turn has a tool_call_id, else a message.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("j", F.when(F.ltrim("text").startswith("{"), F.from_json("text", _TURN, {"mode": "PERMISSIVE"})))
    beside = "j.tool_call_id is not null or coalesce(j.content, '') <> ''"
    calls = t.where("size(j.tool_calls) > 0").select("conv_id", "turn", "role", F.expr(f"if({beside}, 1, 0)").alias("before"), F.posexplode("j.tool_calls").alias("idx", "raw"))
    calls = calls.withColumn("c", F.from_json("raw", _CALL)).select("conv_id", "turn", (F.col("idx") + F.col("before")).alias("idx"), F.lit("call").alias("kind"), "role", F.col("c.id").alias("id"), F.coalesce("c.function.name", "c.name").alias("name"), F.coalesce("c.function.arguments", "c.arguments", F.lit("{}")).alias("body"), other_fields("raw").alias("extra"))
    has_calls = F.coalesce(F.size("j.tool_calls"), F.lit(0)) > 0
    rest = t.where(f"j is null or coalesce(size(j.tool_calls), 0) <= 0 or {beside}")
    result = F.col("j.tool_call_id").isNotNull()
    rest = rest.select("conv_id", "turn", F.lit(0).alias("idx"), F.when(result, "result").otherwise("message").alias("kind"), "role", F.col("j.tool_call_id").alias("id"), F.lit(None).cast("string").alias("name"), F.when(result, F.coalesce("j.content", F.lit(""))).when(has_calls, F.col("j.content")).otherwise(F.col("text")).alias("body"), F.lit(None).cast("string").alias("extra"))
    return calls.unionByName(rest)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level, upto for calls (conv_id, id, turn, answer, deps array): depth in the order of dependencies, and the last turn
    of the call, of those before it, and of their answers. Calls on a cycle, or behind one, keep level null. A loop of joins, one a level."""
    waits = materialize(calls.select("conv_id", "id", F.explode("deps").alias("dep")).join(calls.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"]).distinct(), "chat-deps")
    free = calls.join(waits.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
    done = materialize(free.select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("upto"), F.greatest("turn", "answer").alias("until")), "chat-levels")
    while True:
        open_ = waits.join(done.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        met = open_.join(done.select("conv_id", F.col("id").alias("dep"), "level", "until"), ["conv_id", "dep"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.count_if(F.col("level").isNull()).alias("missing"), F.max("level").alias("level"), F.max("until").alias("until")).where("missing = 0")
        ready = ready.join(calls.select("conv_id", "id", "turn", "answer"), ["conv_id", "id"]).select("conv_id", "id", (F.col("level") + 1).alias("level"), F.greatest("until", "turn").alias("upto"), F.greatest("until", "turn", "answer").alias("until"))
        ready = materialize(ready, "chat-ready")
        if not ready.limit(1).count():
            return done.drop("until")
        then = materialize(done.unionByName(ready), "chat-levels")
        discard(done)
        discard(ready)
        done = then


def linked(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, idx, kind, position, call_turn, status, json: a row for each event of the conversations.

    position counts a conversation's events from 0 in an order where a call stands after the calls it depends on and their first
    results, and before its own results, otherwise by turn. status: ok; for calls also cycle, duplicate id, no result, or the schema's
    fault; for results orphan. json: the event as canonical JSON. A result belongs to the first call of its conversation with its id.
    Null texts are empty messages; turns without a conversation id stand alone, linked to nothing, with a null position; null turns
    stand first; equal rows are all kept, next to each other; very long texts are rows like others; other columns of turns, whatever
    their names, aren't looked at; an empty table gives an empty result. No conversation is gathered: joins are by (conversation,
    id), positions are prefix sums over pieces of it.
    """
    e = materialize(events(turns), "chat-events")
    named = e.where("conv_id is not null")
    calls = named.where("kind = 'call' and id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "idx", "body")).alias("c"))
    results = named.where("kind = 'result' and id is not null").groupBy("conv_id", "id").agg(F.min(F.coalesce("turn", F.lit(-1))).alias("first"))
    calls = calls.join(results, ["conv_id", "id"], "left").withColumn("turn", F.coalesce("c.turn", F.lit(0)))
    calls = calls.select("conv_id", "id", "turn", "c.idx", F.coalesce("first", "turn").alias("answer"), F.regexp_extract_all("c.body", F.lit(r"\$\{([^}]+)\}")).alias("deps"))
    calls = materialize(calls, "chat-calls")
    first = calls.select("conv_id", "id", F.col("turn").alias("call_turn"), F.col("idx").alias("call_idx")).join(levels(calls), ["conv_id", "id"], "left")
    answered = results.select("conv_id", "id", F.lit(True).alias("answered"))
    linkable = named.where("kind <> 'message' and id is not null").join(first, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left")
    others = e.where("kind = 'message' or id is null or conv_id is null")
    for c, kind in (("call_turn", "long"), ("call_idx", "int"), ("level", "int"), ("upto", "long"), ("answered", "boolean")):
        others = others.withColumn(c, F.lit(None).cast(kind))
    own = linkable.unionByName(others.select(linkable.columns))
    call, result, alone = F.col("kind") == "call", F.col("kind") == "result", F.col("conv_id").isNull()
    fault = F.when(call, validator(schemas)(F.col("name"), F.col("body")))
    status = (
        F.when(call & ~alone & (F.col("id").isNull() | (F.struct(F.coalesce("turn", F.lit(0)), "idx") != F.struct("call_turn", "call_idx"))), "duplicate id").when(call & ~alone & F.col("level").isNull(), "cycle")
        .when(call & fault.isNotNull(), fault).when(call & F.col("answered").isNull(), "no result").when(result & F.col("call_turn").isNull(), "orphan").otherwise("ok")
    )
    body = F.when(call, F.coalesce(canonical_json(F.col("body")), F.col("body"))).otherwise(F.col("body"))
    text = F.when(call, F.to_json(F.struct(body.alias("arguments"), "extra", "id", "name", "role"))).when(result, F.to_json(F.struct(F.col("body").alias("content"), "role", F.col("id").alias("tool_call_id")))).otherwise(F.to_json(F.struct(F.col("body").alias("content"), "role")))
    step = F.coalesce(F.col("level") * 2, F.lit(0)) + F.when(result & F.col("call_turn").isNotNull(), 1).otherwise(0)
    at = F.coalesce(F.greatest("turn", "upto"), F.lit(-1))
    out = own.select("conv_id", "turn", "idx", "kind", F.when(result, F.col("call_turn")).alias("call_turn"), status.alias("status"), text.alias("json"), step.alias("step"), at.alias("at"), F.floor(at / 256).alias("piece"))
    placed = running(out.where(~alone), "conv_id", "piece", [F.col("at"), F.col("step"), F.col("turn"), F.col("idx"), F.col("json")], F.lit(1), "n")
    columns = ("conv_id", "turn", "idx", "kind", "position", "call_turn", "status", "json")
    return placed.withColumn("position", F.col("n") - 1).select(*columns).unionByName(out.where(alone).withColumn("position", F.lit(None).cast("long")).select(*columns))
