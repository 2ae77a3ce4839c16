"""Tool calls in conversations: linked, ordered, validated and serialised.

Calls and results meet in a hash join on the call's identifier. Calls that use the results
of others are put in topological order by peeling: a round takes all calls whose needs are
met, so there are as many rounds as the longest chain, whatever the number of calls, and no
conversation is gathered in one task. Calls on a cycle, or that need one, have no level.
Arguments are checked against the tool's schema, then written as canonical JSON: keys
sorted, no blanks, Unicode as it is, numbers as the shortest that read back the same.

Defined results: arguments that are NULL or no JSON object are invalid and serialise as
they are, in a string; a tool without a schema is invalid; a call without a result has none
linked, one with several links to the first (least ``result_order``) and counts them; a
NULL identifier links to nothing; needs that name no call are ignored; calls that repeat
an identifier are each linked and share a level. Empty tables give empty results. Arguments
are also invalid where they nest deeper than ``DEPTH`` or hold what JSON or UTF-8 can't:
NaN, infinities (``1e999`` is one), parts of surrogate pairs, a number too long to read. Other
columns of ``calls`` are kept, but for those named like an added one, which is put in their place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import add_columns
from remedia.session import scratch_path

DEPTH = 64  # levels of nesting in arguments
ADDED = ("n_results", "result", "level", "valid", "message")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list,
         "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema (type, enum, required, properties, items, bounds)."""
    kinds = schema.get("type", list(TYPES))
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if not any(isinstance(value, TYPES[k]) and (k == "boolean" or not isinstance(value, bool) or k not in ("integer", "number"))
               for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    if isinstance(value, list):
        for i, x in enumerate(value):
            out += problems(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in fields:
                out += problems(x, fields[k], f"{at}.{k}")
            elif not schema.get("additionalProperties", True):
                out.append(f"{at}.{k}: not known")
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _sound(value, depth: int = DEPTH) -> bool:
    """Whether a value can be written as JSON in UTF-8 and nests no deeper than ``depth``."""
    if isinstance(value, str):
        return not any("\ud800" <= c <= "\udfff" for c in value)
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, dict):
        return depth > 0 and all(_sound(k) and _sound(x, depth - 1) for k, x in value.items())
    return not isinstance(value, list) or (depth > 0 and all(_sound(x, depth - 1) for x in value))


def read(text: str | None) -> dict | None:
    """The JSON object that a text holds; None where it is none, or not sound."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and _sound(value) else None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """call_id, level: 0 for calls that need none. ``needs``: call_id, needs (another call's id).

    A round writes its calls and what is left into its folder of one table each, so the result
    is one scan however long the longest chain.
    """
    spark, path = calls.sparkSession, scratch_path(calls.sparkSession, "levels")

    def put(rows: DataFrame, name: str, at: int) -> DataFrame:
        rows.write.parquet(f"{path}/{name}/level={at}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}/level={at}")

    left = put(calls.select("call_id").where("call_id IS NOT NULL").distinct(), "left", 0)
    open_needs = put(needs.select("call_id", "needs").distinct().join(
        left.select(F.col("call_id").alias("needs")), "needs", "left_semi").join(
        left, "call_id", "left_semi").select("call_id", "needs"), "needs", 0)
    level = 0
    while True:
        ready = put(left.join(open_needs.select("call_id"), "call_id", "left_anti"), "ready", level)
        if ready.isEmpty():
            break
        left = put(left.join(ready, "call_id", "left_anti"), "left", level + 1)
        open_needs = put(open_needs.join(
            ready.select(F.col("call_id").alias("needs")), "needs", "left_anti").select("call_id", "needs"), "needs", level + 1)
        level += 1
    return spark.read.schema(ready.schema.add("level", "integer")).parquet(f"{path}/ready")


def link(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` (call_id, name, arguments, ...) with n_results, result, level, valid, message.

    ``results``: call_id, result_order, content.
    """
    calls = calls.drop(*ADDED)
    found = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("result_order", "content")).alias("_first")).select(
        F.col("call_id").alias("_of"), F.struct("_n", F.col("_first.content").alias("content")).alias("_found"))
    placed = levels(calls, needs).select(F.col("call_id").alias("_placed"), F.col("level"))
    joined = calls.join(found, F.col("call_id") == F.col("_of"), "left").join(
        placed, F.col("call_id") == F.col("_placed"), "left").select(
        *calls.columns, F.coalesce("_found._n", F.lit(0)).alias("n_results"), F.col("_found.content").alias("result"), "level")
    shapes = json.dumps(schemas)

    def finish() -> Callable:
        known = json.loads(shapes)

        def work(ids: list, names: list, texts: list, contents: list) -> tuple[list, list]:
            valid, message = [], []
            for call_id, name, text, result in zip(ids, names, texts, contents, strict=True):
                arguments = read(text)
                valid.append(arguments is not None and name in known and not problems(arguments, known[name]))
                message.append(canonical({
                    "arguments": text if arguments is None else arguments, "id": call_id, "name": name, "result": result}))
            return valid, message

        return work

    return add_columns(joined, ["call_id", "name", "arguments", "result"], finish,
                       {"valid": "boolean", "message": "string"}, drop=[])
