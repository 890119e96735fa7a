"""Tool calls linked to their results, ordered by what they build on, validated and serialised. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Parameters of each tool: JSON type, and whether a call must have it.
SCHEMAS = {
    "search": {"text": ("string", True), "words": ("integer", True)},
    "summarise": {"ratio": ("number", False), "text": ("string", True), "words": ("integer", True)},
    "translate": {"target": ("string", True), "text": ("string", True)},
}
#: Variant types that each JSON type takes.
_KINDS = {
    "string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$",
}


def argument_errors(name: str, arguments: str, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted texts of what is wrong: not-json, unknown-tool, missing:p, type:p and unknown:p. A null argument is as if absent."""
    value = F.try_parse_json(arguments)
    broken = value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT")
    keys = F.json_object_keys(arguments)
    found = F.array(F.lit("unknown-tool"))
    for tool, params in schemas.items():
        checks = []
        for param, (kind, required) in sorted(params.items()):
            type_ = F.schema_of_variant(F.try_variant_get(value, f"$['{param}']", "variant"))
            absent = type_.isNull() | (type_ == "VOID")
            checks.append(F.when(absent, F.lit(f"missing:{param}") if required else F.lit(None)).when(~type_.rlike(_KINDS[kind]), F.lit(f"type:{param}")))
        unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, params))), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*checks)), F.coalesce(unknown, F.array().cast("array<string>"))))
        found = F.when(F.col(name) == tool, errors).otherwise(found)
    return F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit("not-json"))).otherwise(found)


def _key(*columns: str) -> Column:
    """One text for an identifier within its conversation, null without the identifier."""
    return F.when(F.col(columns[-1]).isNotNull(), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)))))


def depths(calls: DataFrame) -> DataFrame:
    """(id, after) to (id, depth): steps from a call that builds on none, by doubling the step that
    each row has taken, so a chain takes rounds in the logarithm of its length. Calls on or behind a cycle have
    a null depth; a call that names one that isn't there builds on none."""
    ids = calls.select("id")
    linked = calls.where("after is not null").join(ids.select(F.col("id").alias("after")).hint("shuffle_hash"), "after", "left_semi").select("id", F.col("after").alias("up"))
    state = ids.join(linked.hint("shuffle_hash"), "id", "left").withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"))
    state = written(state, "depths")
    rounds = ceil(log2(state.count() + 1)) + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(above.hint("shuffle_hash"), "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = written(state, "depths")
    return state.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """calls (conv_id, turn, call_id, name, arguments, after) and results (conv_id, turn, call_id, content) to a row for each call:
    conv_id, turn, call_id, depth, valid, errors, has_result and `json`, canonical: keys in order, no white space.

    Identifiers hold within a conversation (a null one is a conversation too), so two that both use `call_0` are kept apart.
    (depth, turn, call_id) orders a conversation's calls after those that they build on. Every call has its row: repeated
    ones share the result and the depth of the first by turn, those without an identifier have no result and stand one
    step after what they build on. Of several results of an identifier the first by turn counts. Null or malformed
    arguments are not-json; results of no call are left out. Columns besides these aren't read; empty tables give no rows.

    Joins are hash joins on keys that are unique on their built side, so that each part of it is small however large a conversation is.
    """
    schemas = SCHEMAS if schemas is None else schemas
    named = calls.select("conv_id", "turn", "call_id", "name", "arguments", _key("conv_id", "call_id").alias("id"), _key("conv_id", "after").alias("after"))
    first = named.where("id is not null").groupBy("id").agg(F.min(F.struct("turn", "after"))["after"].alias("after"))
    first = written(first, "calls")
    answer = results.select(_key("conv_id", "call_id").alias("id"), "turn", "content").where("id is not null").groupBy("id").agg(F.min(F.struct("turn", "content")).alias("r"))
    answer = answer.select("id", F.lit(True).alias("answered"), F.col("r.content").alias("content"))
    known = written(depths(first).join(answer.hint("shuffle_hash"), "id", "left"), "answers")
    own = named.where("id is not null").join(known.hint("shuffle_hash"), "id").select("conv_id", "turn", "call_id", "name", "arguments", "depth", "answered", "content")
    above = known.select(F.col("id").alias("after"), "depth", F.lit(True).alias("there"))
    loose = named.where("id is null").join(above.hint("shuffle_hash"), "after", "left").select(
        "conv_id", "turn", "call_id", "name", "arguments", F.when(F.col("there"), F.col("depth") + 1).otherwise(0).alias("depth"), F.lit(None).cast("boolean").alias("answered"), F.lit(None).cast("string").alias("content")
    )
    full = own.unionByName(loose).withColumn("errors", argument_errors("name", "arguments", schemas))
    full = full.withColumns({"valid": F.size("errors") == 0, "has_result": F.coalesce("answered", F.lit(False))})
    tidy = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    or_null = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    parts = [("arguments", tidy), ("depth", number("depth")), ("errors", F.to_json("errors")), ("id", or_null("call_id")), ("name", or_null("name")), ("result", or_null("content")), ("valid", F.col("valid").cast("string"))]
    body = reduce(lambda a, b: [*a, F.lit(',"' + b[0] + '":'), b[1]], parts[1:], [F.lit('{"arguments":'), parts[0][1]])
    return full.select("conv_id", "turn", "call_id", "depth", "valid", "errors", "has_result", F.concat(*body, F.lit("}")).alias("json"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as the conversations imply them: each assistant turn calls a tool with its whole text, building on the
    call two turns before; the user turn after it holds the result. A turn without a number or a conversation makes a call without an identifier."""
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    kind = F.pmod(F.floor(turn / 2), F.lit(3))
    count = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    arguments = F.when(kind == 0, F.to_json(F.struct("text", count.alias("words")))).when(kind == 1, F.to_json(F.struct(F.lit(0.5).alias("ratio"), "text", count.cast("string").alias("words"))))
    arguments = arguments.otherwise(F.to_json(F.struct(F.when(F.pmod("conv_id", F.lit(2)) == 0, "en").alias("target"), "text")))
    name = F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate")
    calls = conversations.where("role = 'assistant'").select("conv_id", "turn", ident(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), ident(turn - 2).alias("after"))
    return calls, conversations.where("role = 'user'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, ((turn // 2) % 3) AS kind, text, len(string_split(coalesce(text, ''), ' ')) AS words,
    'c' || conv_id || '-' || (turn - 2) AS after
  FROM conversations WHERE role = 'assistant'),
d AS (SELECT call_id, 0::BIGINT AS depth FROM t WHERE after NOT IN (SELECT call_id FROM t)
  UNION ALL SELECT t.call_id, d.depth + 1 FROM t JOIN d ON t.after = d.call_id),
r AS (SELECT 'c' || conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user'),
e AS (SELECT t.*, d.depth, r.content, r.call_id IS NOT NULL AS has_result,
  CASE WHEN kind = 0 THEN []::VARCHAR[] WHEN kind = 1 THEN ['type:words'] WHEN conv_id % 2 = 0 THEN []::VARCHAR[] ELSE ['missing:target'] END AS errors,
  CASE WHEN kind = 0 THEN '{"text":' || to_json(text)::VARCHAR || ',"words":' || words || '}'
    WHEN kind = 1 THEN '{"ratio":0.5,"text":' || to_json(text)::VARCHAR || ',"words":"' || words || '"}'
    WHEN conv_id % 2 = 0 THEN '{"target":"en","text":' || to_json(text)::VARCHAR || '}' ELSE '{"text":' || to_json(text)::VARCHAR || '}' END AS arguments
  FROM t JOIN d USING (call_id) LEFT JOIN r USING (call_id))
SELECT conv_id, turn, call_id, depth, len(errors) = 0 AS valid, errors, has_result,
  '{"arguments":' || arguments || ',"depth":' || depth || ',"errors":' || to_json(errors)::VARCHAR || ',"id":"' || call_id || '","name":"'
  || CASE kind WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'translate' END || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
  || ',"valid":' || (len(errors) = 0)::VARCHAR || '}' AS json
FROM e
"""
