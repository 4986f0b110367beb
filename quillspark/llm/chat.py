"""Chat formatting, in DataFrame functions only: tool calls linked to their results, ordered, validated, as canonical JSON.

Calls stand in assistant messages as ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``, results in
any message as ``<tool_result>{"id": ..., "content": ...}</tool_result>``. A call is hash-joined to its result by
(conversation, identifier). An argument string ``$id`` refers to the result of another call: a call comes after those
that it refers to (its `depth`). Arguments are checked against the tools' schemas. The JSON has sorted keys and no
white space. Every join key holds the identifier, so a conversation with very many messages is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import materialize

# The tools' schemas (argument: type, required).
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "timeout": ("number", False), "follow": ("boolean", False)},
}
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
REFERENCE = r'"\$([A-Za-z0-9_.-]+)"'


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys of which null ones are equal."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_right_{k}" for k in keys))


def quoted(text: Column) -> Column:
    """A string as a JSON string; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, place, call_id, name, arguments, refers, raw): one row per well- or ill-formed call.

    message is the sha-256 of the text; rows that repeat a message are one message. raw is the body where the call
    isn't an object of id, name and arguments only, so nothing of it is lost.
    """
    asked = messages.where((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))).distinct()
    each = asked.select("conv_id", "turn", F.sha2("text", 256).alias("message"), F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("place", "body"))
    body = F.try_parse_json("body")
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    arguments = F.to_json(get("$.arguments", "variant"))
    refers = F.array_distinct(F.regexp_extract_all(arguments, F.lit(REFERENCE), F.lit(1)))
    known = F.array(*map(F.lit, ("id", "name", "arguments")))
    whole = F.coalesce(F.size(F.array_except(F.json_object_keys(F.to_json(body)), known)) == 0, F.lit(False))
    return each.select("conv_id", "turn", "message", "place", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"), arguments.alias("arguments"), F.coalesce(refers, F.array().cast("array<string>")).alias("refers"), F.when(~whole, F.col("body")).alias("raw"))


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result, result_turn, results): the first result of each identifier, by turn, and how many there are."""
    told = messages.where(F.contains("text", F.lit("<tool_result>"))).distinct()
    each = told.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(RESULT), F.lit(1))).alias("place", "body"))
    body = F.try_parse_json("body")
    named = each.select("conv_id", "turn", "place", F.try_variant_get(body, "$.id", "string").alias("call_id"), F.to_json(F.try_variant_get(body, "$.content", "variant")).alias("content"))
    first = F.min(F.struct("turn", "place", "content"))
    return named.where("call_id is not null").groupBy("conv_id", "call_id").agg(first.alias("f"), F.count("*").alias("results")).select("conv_id", "call_id", F.col("f.content").alias("result"), F.col("f.turn").alias("result_turn"), "results")


def faults(name: Column, arguments: Column, tools: dict) -> Column:
    """What is wrong with a call's arguments, as an array of strings."""
    kinds = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}
    parsed = F.try_parse_json(arguments)
    cases = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(tools.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            here = F.array_contains(F.json_object_keys(arguments), field)
            fits = F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(f"^({kinds[kind]})$")), F.lit(False))
            refers = F.coalesce(F.rlike(F.to_json(value), F.lit(f"^{REFERENCE}$")), F.lit(False))
            found.append(F.when(here & ~fits & ~refers, f"{field}: not {kind}"))
            if required:
                found.append(F.when(~here, f"{field}: missing"))
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(fields))))), lambda k: F.concat(k, F.lit(": unknown")))
        cases = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), extra)).otherwise(cases)
    return F.when(name.isNull(), F.array(F.lit("no name"))).when(arguments.isNull() | F.json_object_keys(arguments).isNull(), F.array(F.lit("no arguments"))).otherwise(cases)


def depths(calls: DataFrame) -> DataFrame:
    """calls with depth: 0 without references to calls of the conversation, else one more than the deepest of them; -1 in or above a cycle.

    Only calls with references enter. Chains of calls with one reference each are shortened by pointer doubling (a chain
    of n calls takes log2 n rounds); what is left are calls with several references, settled layer by layer (Kahn).
    """
    key = ["conv_id", "call_id"]
    keyed = calls.where("call_id is not null").select(*key).distinct()
    needs = calls.where("call_id is not null and size(refers) > 0").select(*key, F.explode("refers").alias("needs")).distinct()
    open_ = materialize(joined(needs, keyed.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "inner"), "needs")
    if open_.isEmpty():
        return calls.withColumn("depth", F.lit(0))
    degree = open_.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("up"))
    chain = materialize(degree.where("n = 1").select(*key, "up", F.lit(1).cast("long").alias("steps")), "chain")
    most, reach = chain.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0, 1
    while reach <= most:
        ahead = chain.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        moved = materialize(joined(chain, ahead, ["conv_id", "up"], "left"), "chain")
        if moved.where("next is not null").isEmpty():
            break
        chain, reach = moved.select(*key, F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), 2 * reach
    # Pointers that, after more steps than there are calls, still end at a call of a chain go round.
    on = chain.select("conv_id", F.col("call_id").alias("up"))
    loops = joined(chain, on, ["conv_id", "up"], "left_semi").select(*key)
    straight = joined(chain, on, ["conv_id", "up"], "left_anti")
    several = degree.where("n > 1").select(*key)
    if several.isEmpty():
        settled = straight.select(*key, F.col("steps").alias("d")).unionByName(loops.withColumn("d", F.lit(-1).cast("long")))
    else:
        tops = layered(joined(open_, several, key, "left_semi"), straight, loops, several)
        ends = joined(straight, tops.withColumnsRenamed({"call_id": "up", "d": "top"}), ["conv_id", "up"], "left")
        below = ends.select(*key, F.when(F.col("top") < 0, F.col("top")).otherwise(F.coalesce("top", F.lit(0)) + F.col("steps")).alias("d"))
        settled = below.unionByName(loops.withColumn("d", F.lit(-1).cast("long"))).unionByName(tops)
    return joined(calls, settled, key, "left").withColumn("depth", F.coalesce("d", F.lit(0)).cast("int")).drop("d")


def layered(edges: DataFrame, chains: DataFrame, loops: DataFrame, several: DataFrame) -> DataFrame:
    """(conv_id, call_id, d) of the calls with several references. edges: conv_id, call_id, needs; chains lead from needs to their ends."""
    key = ["conv_id", "call_id"]
    through = chains.select("conv_id", F.col("call_id").alias("needs"), F.col("up").alias("end"), "steps")
    ends = joined(edges, through, ["conv_id", "needs"], "left").select(*key, "needs", F.coalesce("end", "needs").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    late = several.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("late"))
    round_ = loops.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("loop"))
    marked = joined(joined(ends, late, ["conv_id", "top"], "left"), round_, ["conv_id", "needs"], "left")
    # An edge's value is null until the call at its top is settled: at once for calls without references, never for a loop.
    left = materialize(marked.select(*key, F.when(F.col("loop").isNull(), F.col("top")).alias("top"), "steps", F.when(F.col("late").isNull() & F.col("loop").isNull(), F.col("steps")).alias("value")), "layer")
    layers = []
    while True:
        state = left.groupBy(*key).agg(F.max("value").alias("d"), F.count_if(F.col("value").isNull()).alias("waits"))
        ready = materialize(state.where("waits = 0").select(*key, "d"), "ready")
        if ready.isEmpty():
            break
        layers.append(ready)
        rest = joined(left, ready, key, "left_anti")
        met = joined(rest, ready.withColumnRenamed("call_id", "top"), ["conv_id", "top"], "left")
        left = materialize(met.select(*key, "top", "steps", F.coalesce("value", F.when(F.col("top").isNotNull(), F.col("d") + F.col("steps"))).alias("value")), "layer")
    cyclic = left.select(*key).distinct().withColumn("d", F.lit(-1).cast("long"))
    return reduce(DataFrame.unionByName, layers, cyclic)


def link_calls(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per call: conv_id, turn, message, place, call_id, name, depth, arguments, result, result_turn, faults, call_json.

    Faults also name a missing or repeated identifier, a missing, repeated or earlier result, and a cycle. In a conversation,
    (depth, turn, place) is a topological order of the calls. Calls without a result keep null ones.
    """
    calls = depths(calls_of(messages))
    uses = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("uses"))
    linked = joined(joined(calls, uses, ["conv_id", "call_id"], "left"), results_of(messages), ["conv_id", "call_id"], "left")
    wrong = F.array(
        F.when(F.col("call_id").isNull(), "no identifier"),
        F.when(F.col("uses") > 1, "repeated identifier"),
        F.when(F.col("results").isNull(), "no result"),
        F.when(F.col("results") > 1, "repeated result"),
        F.when(F.col("result_turn") < F.col("turn"), "result before call"),
        F.when(F.col("depth") < 0, "cycle"),
    )
    checked = linked.withColumn("faults", F.concat(F.array_compact(wrong), faults(F.col("name"), F.col("arguments"), TOOLS if tools is None else tools)))
    null = F.lit("null")
    json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", null), F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), null), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.coalesce(F.concat(F.lit(',"raw":'), quoted(F.col("raw"))), F.lit("")), F.lit(',"result":'), F.coalesce("result", null), F.lit("}"))
    return checked.select("conv_id", "turn", "message", "place", "call_id", "name", "depth", "arguments", "result", "result_turn", "faults", json.alias("call_json"))


def format_messages(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_faults, message_json.

    message_json is ``{"content":text,"role":role}``; an assistant's calls stand in ``"tool_calls"``, in topological order,
    and are taken out of its content. Null roles and texts are JSON nulls. Rows that repeat a message count as one for
    its calls and results, and each comes out; messages that differ in their text are apart even where they share
    conversation and turn. A null conversation or turn is a key like any other. A call that isn't an object of id, name
    and arguments only keeps its body as ``"raw"``. Other columns are ignored; an empty table gives no row.
    """
    messages = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls = link_calls(messages, tools)
    listed = F.array_sort(F.collect_list(F.struct("depth", "place", "call_json")))
    per_message = calls.groupBy("conv_id", "turn", "message").agg(listed.alias("calls"), F.count("*").alias("n_calls"), F.sum(F.size("faults")).alias("n_faults"))
    has = F.contains("text", F.lit("<tool_call>")) & (F.col("role") == "assistant")
    asking = messages.where(F.coalesce(has, F.lit(False))).withColumn("message", F.sha2("text", 256))
    with_calls = joined(asking, per_message, ["conv_id", "turn", "message"], "left")
    plain = messages.where(~F.coalesce(has, F.lit(False)))
    null, zero = F.lit("null"), F.lit(0).cast("long")
    content = F.trim(F.regexp_replace("text", CALL, ""))
    array = F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: c["call_json"]), ","), F.lit("]"))
    told = with_calls.select("conv_id", "turn", "role", F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_faults", zero).alias("n_faults"), F.concat(F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_calls":'), F.coalesce(array, F.lit("[]")), F.lit("}")).alias("message_json"))
    rest = plain.select("conv_id", "turn", "role", zero.alias("n_calls"), zero.alias("n_faults"), F.concat(F.lit('{"content":'), F.when(F.col("text").isNull(), null).otherwise(quoted(F.col("text"))), F.lit(',"role":'), F.when(F.col("role").isNull(), null).otherwise(quoted(F.col("role"))), F.lit("}")).alias("message_json"))
    return told.unionByName(rest)
