"""Chat formatting with tool-call linking, with DataFrame functions only.

A message may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>`` (any number), or be a
result: role ``tool`` with ``{"tool_call_id", "content"}``.  Calls and results of a conversation are
hash-joined by identifier; arguments are validated against the tools' schemas; every message becomes
canonical JSON (keys sorted, no blanks).  The order is topological: a result stands after its call, all
else keeps its turn.  It is given as sort columns, one row a message, so no conversation is gathered.

Defined results: of several calls with one identifier the earliest (turn, then place) counts and the
others are ``duplicate``; a result without a call is ``orphan`` and keeps its turn; several results of a
call are all linked, by turn; a null text is empty, a null role ``""``; a call that is not a JSON object stays in the
message's text, which is else as it was without its calls; further fields of a call or result are its message's
``more``; an unknown tool is invalid; repeated rows each give a row; columns other than conv_id, turn, role and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

CALL_RE = r"(?s)<tool_call>(.*?)</tool_call>"
#: The default tools: name → (required argument → JSON type, optional argument → JSON type).
TOOLS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "search": ({"query": "string"}, {"limit": "integer"}),
    "calculator": ({"expression": "string"}, {}),
    "fetch": ({"url": "string"}, {"timeout": "number"}),
    "python": ({"code": "string"}, {}),
}
#: Types of a VARIANT, as ``schema_of_variant`` names them, that a JSON schema type allows.
_TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$|^DECIMAL\\([0-9]+,0\\)$", "number": "^BIGINT$|^DOUBLE$|^DECIMAL", "boolean": "^BOOLEAN$",
    "object": "^OBJECT", "array": "^ARRAY",
}


def _field(variant: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(variant), path, kind)


def _is_object(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))


def _more(*known: str) -> Column:
    """What ``json`` holds besides the known fields, as an object; null without any."""
    rest = F.map_filter(F.try_variant_get("json", "$", "map<string,variant>"), lambda key, _: ~key.isin(*known))
    return F.when(F.size(rest) > 0, F.to_variant_object(rest))


def _problem(tools) -> Column:
    """The first thing wrong with the arguments ``args`` of tool ``name``; null if nothing is."""
    out = F.when(F.col("name").isNull(), "no name")
    for tool, (required, optional) in tools.items():
        wrong = F.lit(None).cast("string")
        for name, kind in {**optional, **required}.items():
            value = F.element_at("given", name)
            bad = value.isNotNull() & ~F.schema_of_variant(value).rlike(_TYPES[kind])
            wrong = F.when(bad, f"type of {name}").otherwise(wrong)
        for name in required:
            wrong = F.when(~F.array_contains(F.map_keys("given"), name), f"missing {name}").otherwise(wrong)
        extra = F.array_except(F.map_keys("given"), F.array(*map(F.lit, [*required, *optional])) if required or optional else F.array().cast("array<string>"))
        wrong = F.coalesce(wrong, F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_min(extra))))
        out = out.when(F.col("name") == tool, F.when(F.col("given").isNull(), "arguments").otherwise(wrong))
    return out.otherwise("unknown tool")


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and, for results, call_id."""
    body = F.coalesce("text", F.lit(""))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), body.alias("text"))
    parsed = base.withColumn("json", F.when(F.col("role") == "tool", F.try_parse_json("text")))
    return parsed.withColumn("result_of", _field("json", "$.tool_call_id"))


def calls(turns: DataFrame, tools=TOOLS) -> DataFrame:
    """conv_id, turn, place, call_id, name, arguments (canonical), more, problem."""
    spoken = messages(turns).where((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"))
    each = spoken.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL_RE), F.lit(1))).alias("place", "raw"))
    each = each.withColumn("json", F.try_parse_json("raw")).where(_is_object(F.col("json")))
    each = each.select(
        "conv_id", "turn", "place", _field("json", "$.id").alias("call_id"), _field("json", "$.name").alias("name"),
        F.try_variant_get("json", "$.arguments", "map<string,variant>").alias("given"), F.to_json(F.try_variant_get("json", "$.arguments", "variant")).alias("arguments"),
        _more("id", "name", "arguments").alias("more"),
    )
    return each.withColumn("problem", _problem(tools)).drop("given")


def _spoken() -> Column:
    """The text without the blocks that are calls; a block that is not a JSON object stays as it is."""
    blocks, between = F.regexp_extract_all("text", F.lit(CALL_RE), F.lit(0)), F.split("text", CALL_RE)
    body = lambda block: F.regexp_extract(block, CALL_RE, 1)
    left = F.transform(blocks, lambda block: F.when(_is_object(F.try_parse_json(body(block))), "").otherwise(block))
    pieces = F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(left, i), F.lit(""))))
    return F.when(F.col("text").contains("<tool_call>"), F.array_join(pieces, "")).otherwise(F.col("text"))


def link(turns: DataFrame, tools=TOOLS) -> DataFrame:
    """One row per message and per call, with sort columns (conv_id, order_turn, order_place, order_kind, turn)."""
    said = messages(turns)
    called = written(calls(turns, tools), "chat-calls")
    first = called.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "name")).alias("call"))
    results = said.where("result_of IS NOT NULL")
    linked = results.join(first, (results["conv_id"].eqNullSafe(first["conv_id"])) & (results["result_of"] == first["call_id"]), "left").drop(first["conv_id"])
    result_rows = linked.select(
        "conv_id", "turn", "role", F.lit("result").alias("kind"), F.coalesce("call.turn", "turn").alias("order_turn"), F.coalesce("call.place", F.lit(-1)).alias("order_place"),
        F.when(F.col("call").isNull(), 0).otherwise(2).alias("order_kind"), F.col("result_of").alias("call_id"),
        F.when(F.col("call").isNull(), "orphan").otherwise("linked").alias("status"),
        F.to_json(F.struct(F.coalesce(F.to_json(F.try_variant_get("json", "$.content", "variant")), F.lit("null")).alias("content"), _more("tool_call_id", "content").alias("more"), F.col("call.name").alias("name"), "role", F.col("result_of").alias("tool_call_id"))).alias("message"),
    )
    call_keys = first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("call.turn").alias("first_turn"), F.col("call.place").alias("first_place"))
    ranked = called.join(call_keys, called["conv_id"].eqNullSafe(call_keys["c"]) & (called["call_id"] == call_keys["i"]), "left")
    status = (
        F.when(F.col("problem").isNotNull(), F.concat(F.lit("invalid: "), "problem")).when(F.col("call_id").isNull(), "no id")
        .when((F.col("turn") != F.col("first_turn")) | (F.col("place") != F.col("first_place")), "duplicate").otherwise("valid")
    )
    call_rows = ranked.select(
        "conv_id", "turn", F.lit("assistant").alias("role"), F.lit("call").alias("kind"), F.col("turn").alias("order_turn"), F.col("place").alias("order_place"), F.lit(1).alias("order_kind"), "call_id", status.alias("status"),
        F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "more", "name")).alias("message"),
    )
    plain = said.where("result_of IS NULL").select(
        "conv_id", "turn", "role", F.lit("message").alias("kind"), F.col("turn").alias("order_turn"), F.lit(-1).alias("order_place"), F.lit(0).alias("order_kind"), F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"),
        F.to_json(F.struct(F.when(F.col("role") == "assistant", _spoken()).otherwise(F.col("text")).alias("content"), "role")).alias("message"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def op3_chat(turns: DataFrame) -> DataFrame:
    return link(turns)


def planted_calls(turns: DataFrame) -> DataFrame:
    """``turns`` with calls after some assistant turns, and results of some of them as further turns: valid calls,
    calls with each kind of fault, repeated identifiers, and results that stand before their call or without one."""
    kind = F.when(F.col("role") == "assistant", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11)))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("kind", kind)
    own = F.concat(F.lit("c"), F.col("turn").cast("string"))

    def call(name: str, arguments: str, call_id: Column | None = own) -> Column:
        head = F.lit("") if call_id is None else F.concat(F.lit('"id":"'), call_id, F.lit('",'))
        return F.concat(F.lit("<tool_call>{"), head, F.lit(f'"name":"{name}","arguments":{arguments}}}</tool_call>'))

    twice = call("calculator", '{"expression":"1+1"}', F.lit("same"))
    said = {
        0: call("search", '{"limit":3,"query":"é"}'), 1: call("search", '{"limit":"3","query":"x"}'), 2: call("search", '{"limit":3}'),
        3: F.concat(twice, F.lit(" and "), twice), 4: call("nope", "{}"), 5: F.lit(" <tool_call>{broken</tool_call> "),
        6: call("fetch", '{"timeout":1.5,"url":"u"}', None), 7: call("python", '{"code":"x","more":1}'), 8: call("fetch", '{"timeout":2,"url":"u"}'),
    }
    more = F.lit("")
    for number, words in said.items():
        more = F.when(F.col("kind") == number, words).otherwise(more)
    answered = rows.where("kind IN (0, 1, 3, 5, 8)").select(
        "conv_id", (F.col("turn") + F.when(F.col("kind") == 8, -1).otherwise(1)).alias("turn"), F.lit("tool").alias("role"),
        F.concat(F.lit('{"tool_call_id":"'), F.when(F.col("kind") == 3, "same").otherwise(own), F.lit('","content":{"b":[true,null],"a":"\\"1\\""}}')).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), more).alias("text")).unionByName(answered)


_PLAIN = """
SELECT conv_id, turn, role, 'message' AS kind, turn AS order_turn, -1 AS order_place, 0 AS order_kind, NULL::VARCHAR AS call_id, 'plain' AS status,
       to_json({'content': %s, 'role': role})::VARCHAR AS message FROM t"""
#: The test table holds no call, so all its turns are messages.
ORACLE_SQL = "WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)" + _PLAIN % "text"
CALLS_SQL = r"""
WITH k AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' THEN (conv_id * 7 + turn) % 11 END AS k, 'c' || turn AS own FROM conversations
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, text || CASE k
    WHEN 0 THEN '<tool_call>{"id":"' || own || '","name":"search","arguments":{"limit":3,"query":"é"}}</tool_call>'
    WHEN 1 THEN '<tool_call>{"id":"' || own || '","name":"search","arguments":{"limit":"3","query":"x"}}</tool_call>'
    WHEN 2 THEN '<tool_call>{"id":"' || own || '","name":"search","arguments":{"limit":3}}</tool_call>'
    WHEN 3 THEN '<tool_call>{"id":"same","name":"calculator","arguments":{"expression":"1+1"}}</tool_call> and <tool_call>{"id":"same","name":"calculator","arguments":{"expression":"1+1"}}</tool_call>'
    WHEN 4 THEN '<tool_call>{"id":"' || own || '","name":"nope","arguments":{}}</tool_call>'
    WHEN 5 THEN ' <tool_call>{broken</tool_call> '
    WHEN 6 THEN '<tool_call>{"name":"fetch","arguments":{"timeout":1.5,"url":"u"}}</tool_call>'
    WHEN 7 THEN '<tool_call>{"id":"' || own || '","name":"python","arguments":{"code":"x","more":1}}</tool_call>'
    WHEN 8 THEN '<tool_call>{"id":"' || own || '","name":"fetch","arguments":{"timeout":2,"url":"u"}}</tool_call>'
    ELSE '' END AS text FROM k
  UNION ALL
  SELECT conv_id, turn + CASE k WHEN 8 THEN -1 ELSE 1 END, 'tool', '{"tool_call_id":"' || CASE k WHEN 3 THEN 'same' ELSE own END || '","content":{"b":[true,null],"a":"\"1\""}}'
  FROM k WHERE k IN (0, 1, 3, 5, 8)
), r AS (
  SELECT *, CASE WHEN role = 'tool' AND json_valid(text) THEN text->>'tool_call_id' END AS result_of FROM t
), b AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS raw,
         unnest(range(len(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1))))::INT AS place FROM t WHERE role = 'assistant'
), c AS (
  SELECT conv_id, turn, place, raw->>'id' AS call_id, raw->>'name' AS name, (raw->'arguments')::VARCHAR AS arguments, raw->'arguments' AS given FROM b WHERE json_valid(raw)
), w AS (
  SELECT *, CASE name
      WHEN 'search' THEN CASE WHEN given->>'query' IS NULL THEN 'missing query' WHEN json_type(given->'query') <> 'VARCHAR' THEN 'type of query'
                              WHEN given->>'limit' IS NOT NULL AND json_type(given->'limit') NOT IN ('BIGINT', 'UBIGINT') THEN 'type of limit' END
      WHEN 'calculator' THEN CASE WHEN given->>'expression' IS NULL THEN 'missing expression' END
      WHEN 'fetch' THEN CASE WHEN given->>'url' IS NULL THEN 'missing url' END
      WHEN 'python' THEN CASE WHEN given->>'code' IS NULL THEN 'missing code' WHEN len(json_keys(given)) > 1 THEN 'unknown ' || list_filter(json_keys(given), lambda x: x <> 'code')[1] END
      ELSE 'unknown tool' END AS problem
  FROM c
), f AS (
  SELECT conv_id, call_id, arg_min({'turn': turn, 'place': place, 'name': name}, {'turn': turn, 'place': place}) AS first FROM c WHERE call_id IS NOT NULL GROUP BY ALL
)
""" + _PLAIN.replace("FROM t", "FROM r WHERE result_of IS NULL") % (
    """CASE WHEN role = 'assistant' THEN regexp_replace(text, '<tool_call>[{]"[^<]*</tool_call>', '', 'g') ELSE text END"""
) + r"""
UNION ALL
SELECT w.conv_id, w.turn, 'assistant', 'call', w.turn, place, 1, w.call_id,
       CASE WHEN problem IS NOT NULL THEN 'invalid: ' || problem WHEN w.call_id IS NULL THEN 'no id'
            WHEN w.turn <> first.turn OR place <> first.place THEN 'duplicate' ELSE 'valid' END,
       '{"arguments":' || to_json(arguments)::VARCHAR || coalesce(',"id":' || to_json(w.call_id)::VARCHAR, '') || ',"name":' || to_json(name)::VARCHAR || '}'
FROM w LEFT JOIN f ON f.conv_id = w.conv_id AND f.call_id = w.call_id
UNION ALL
SELECT r.conv_id, r.turn, role, 'result', coalesce(first.turn, r.turn), coalesce(first.place, -1), CASE WHEN first IS NULL THEN 0 ELSE 2 END, result_of,
       CASE WHEN first IS NULL THEN 'orphan' ELSE 'linked' END,
       '{"content":' || to_json('{"a":"\"1\"","b":[true,null]}'::VARCHAR)::VARCHAR || coalesce(',"name":' || to_json(first.name)::VARCHAR, '') || ',"role":"tool","tool_call_id":' || to_json(result_of)::VARCHAR || '}'
FROM r LEFT JOIN f ON f.conv_id = r.conv_id AND f.call_id = result_of WHERE result_of IS NOT NULL
"""
