"""Chat formatting: tool calls linked with their results, put in order, validated and written as canonical JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.ordering import running_sum
from tidewater.llm.common import numbered, partitions
from tidewater.session import checkpointed

CALLS = "tool_calls array<struct<id:string,name:string,after:string,arguments:variant>>"
RESULT = "tool_call_id string, content string"
#: JSON schema types and what Spark calls the type of such a value.
TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}
#: Turns in a slice of ordered work, and a place behind all calls of a message.
TURNS_OF_SLICE = 1024
MOST_PLACES = 2**31 - 1
#: Rounds of doubling after which a chain is longer than any table.
MOST_ROUNDS = 64


def problems_of(name: Column, arguments: Column, schemas: dict[str, dict[str, Any]]) -> Column:
    """array<string> of what is wrong with the arguments (variant) of a call of tool `name`; empty if all is well.

    A schema is a JSON schema of an object: properties with type, minLength, maxLength, minimum, maximum and enum,
    required, and additionalProperties. It becomes one expression for each rule.
    """
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        rules = []
        for field, rule in schema.get("properties", {}).items():
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            text, number = (F.try_variant_get(arguments, f"$.{field}", t) for t in ("string", "double"))
            say = lambda what, wrong, field=field: rules.append(F.when(wrong, F.lit(f"{field}: {what}")))
            if field in schema.get("required", ()):
                say("missing", value.isNull())
            if "type" in rule:
                say(f"not a {rule['type']}", value.isNotNull() & ~kind.rlike(TYPES[rule["type"]]))
            if "minLength" in rule:
                say("too short", F.length(text) < rule["minLength"])
            if "maxLength" in rule:
                say("too long", F.length(text) > rule["maxLength"])
            if "minimum" in rule:
                say("too small", number < rule["minimum"])
            if "maximum" in rule:
                say("too large", number > rule["maximum"])
            if "enum" in rule:
                say("not allowed", ~text.isin(*rule["enum"]))
        if schema.get("additionalProperties") is False:
            known = F.array(*(F.lit(f) for f in schema.get("properties", {}))).cast("array<string>")
            extra = F.array_except(F.json_object_keys(F.to_json(arguments)), known)
            rules.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ", "))))
        own = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
        found = F.when(name == tool, own).otherwise(found)
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, found).otherwise(F.array(F.lit("arguments: not an object")))


def depths(calls: DataFrame) -> DataFrame:
    """(conversation, id, depth) of calls (conversation, id, after): steps up to a call that follows none.

    Each round doubles how far up a call has looked, so a chain of n calls takes log2(n) rounds, each written to the
    shared folder. Calls in a circle, and those that follow one, never reach the top: depth null.
    """
    known = calls.select("conversation", F.col("id").alias("_known"))
    up = F.when(F.col("_known").isNotNull(), F.col("after"))
    state = calls.join(known.withColumnRenamed("conversation", "_c"), (F.col("conversation") == F.col("_c")) & (F.col("after") == F.col("_known")), "left")
    state = checkpointed(state.select("conversation", "id", up.alias("up"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("steps")))
    open_before = -1
    for _ in range(MOST_ROUNDS):
        still = state.where("up is not null").count()
        if still in (0, open_before):
            break
        open_before = still
        above = state.select(F.col("conversation").alias("_c"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        raised = state.join(above, (F.col("conversation") == F.col("_c")) & (F.col("up") == F.col("_id")), "left")
        state = checkpointed(
            raised.select("conversation", "id", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        )
    return state.select("conversation", "id", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def numbers(items: DataFrame) -> DataFrame:
    """Items (conversation, id, turn, place, kind, …) with `number`: how many calls of their identifier stand up to them.

    Kinds are 0 for a reference to a call, 1 for a call, 2 for a result; at one place they stand in this order. So an
    identifier that is used again starts anew, and a result or reference belongs to the last call before it.
    """
    return running_sum(
        items, ["conversation", "id"], ["turn", "place", "kind", "tie"], F.floor(F.col("turn") / TURNS_OF_SLICE), (F.col("kind") == 1).cast("int"), "number"
    )


def link_calls(
    messages: DataFrame, schemas: dict[str, dict[str, Any]], conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conversation, id, status, position, depth, turn, result_turn, problems, valid, json): all calls, results and
    other messages.

    Messages of role `assistant` whose text is a JSON object with `tool_calls` make calls; those of role `tool` with a
    `tool_call_id` give results. Both are hash-joined on conversation, identifier and number, as an identifier may be
    used again: a result belongs to the last call of its identifier before it. A call is `linked` with its first result
    or `unanswered`; a further result is `repeated`, one before any call an `orphan`. A message that makes neither call
    nor result is a `message`, so every turn is accounted for.

    A call may name another that it comes `after`: the last of that identifier before it, else the first. `depth` is its
    level in that forest; `position` numbers the calls and results of a conversation so that no call stands before the
    one it follows (by depth, then turn). `json` is canonical: keys sorted, no space, absent fields left out. Rows are
    calls, never whole conversations: numbers come from slices and ranges, so that a conversation that holds a third of
    all rows is spread like any other.

    A call after an unknown call is a first call and has that as a problem; calls in a circle, and those that follow one,
    have no depth and that problem, and stand last. A call without identifier is unanswered and has that as a problem.
    Null or malformed texts, other roles and null conversations make messages. Ties of turns are ordered by the item's
    JSON; very long texts are values like any other; repeated rows repeat, the second call of an identifier being a use
    of its own. An empty table gives no rows. Other columns are not read.
    """
    rows = checkpointed(
        messages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(conversation).alias("conversation"),
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            F.col(text).alias("text"),
        )
        .withColumn("calls", F.when((F.col("role") == "assistant") & F.col("conversation").isNotNull(), F.from_json("text", CALLS)["tool_calls"]))
        .withColumn("result", F.when((F.col("role") == "tool") & F.col("conversation").isNotNull(), F.from_json("text", RESULT)))
        .withColumn("result", F.when(F.col("result.tool_call_id").isNotNull(), F.col("result")))
    )
    opened = rows.select("conversation", "turn", "row", F.posexplode("calls").alias("place", "call")).select(
        "conversation",
        "turn",
        "place",
        F.col("call.id").alias("id"),
        "call.name",
        "call.after",
        F.to_json("call.arguments").alias("arguments"),
        F.to_json("call").alias("tie"),
        problems_of(F.col("call.name"), F.col("call.arguments"), schemas).alias("problems"),
    )
    opened = checkpointed(opened.withColumn("item", F.monotonically_increasing_id()))
    calls = opened.where("id IS NOT NULL")
    results = rows.where("result IS NOT NULL").select(
        "conversation", "turn", F.lit(MOST_PLACES).alias("place"), F.col("result.tool_call_id").alias("id"), "result.content", F.col("row").alias("item")
    )
    narrow = ("conversation", "turn", "place", "item")
    items = (
        calls.select(*narrow, "id", F.lit(1).alias("kind"), F.sha2("tie", 256).alias("tie"))
        .unionByName(calls.where("after IS NOT NULL").select(*narrow, F.col("after").alias("id"), F.lit(0).alias("kind"), F.sha2("tie", 256).alias("tie")))
        .unionByName(results.select(*narrow, "id", F.lit(2).alias("kind"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("tie")))
    )
    counted = checkpointed(numbers(items))
    own = counted.where("kind = 1").select("item", "number")
    referred = counted.where("kind = 0").select("item", F.greatest(F.col("number"), F.lit(1)).alias("after_number"))
    # Of a call's results the first counts: their order within the identifier, less that of the call's first.
    answered = counted.where("kind = 2").select("conversation", "id", "number", "item", F.struct("turn", "tie", "item").alias("order"))
    first = answered.groupBy("conversation", "id", "number").agg(F.min("order")["item"].alias("item"), F.lit(True).alias("first"))
    first = first.select("item", "first")
    numbered_results = results.join(answered.select("item", "number"), "item").join(first, "item", "left").select(
        "conversation", "id", "number", F.coalesce("first", F.lit(False)).alias("first"), F.struct("turn", "content").alias("result")
    )
    numbered_calls = checkpointed(calls.join(own, "item").join(referred, "item", "left").drop("place", "item", "tie"))
    key = lambda name, number: F.to_json(F.struct(F.col(name).alias("id"), F.col(number).alias("n")))
    levels = depths(
        numbered_calls.select("conversation", key("id", "number").alias("id"), F.when(F.col("after").isNotNull(), key("after", "after_number")).alias("after"))
    )
    known = numbered_calls.select("conversation", F.col("id").alias("after"), F.col("number").alias("after_number"), F.lit(True).alias("known"))
    placed = (
        numbered_calls.withColumn("_key", key("id", "number"))
        .join(levels.withColumnRenamed("id", "_key"), ["conversation", "_key"])
        .join(known, ["conversation", "after", "after_number"], "left")
        .drop("_key")
        .withColumn("is_call", F.lit(True))
    )
    answers = numbered_results.where("first AND number > 0").select("conversation", "id", "number", "result")
    linked = placed.join(answers.hint("shuffle_hash"), ["conversation", "id", "number"], "left")
    nameless = opened.where("id IS NULL").select(
        "conversation", "turn", "name", "after", "arguments",
        F.array_append("problems", F.lit("id: missing")).alias("problems"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("is_call"), F.lit(True).alias("known"),
    )
    others = numbered_results.where("NOT first OR number = 0").select("conversation", "id", "number", "result")
    acted = linked.unionByName(nameless, allowMissingColumns=True).unionByName(others, allowMissingColumns=True)
    stray = F.when(F.col("after").isNotNull() & F.col("known").isNull(), F.lit("after: unknown call"))
    circle = F.when(F.col("is_call") & F.col("depth").isNull(), F.lit("after: a circle"))
    problems = F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.array_compact(F.array(stray, circle)))
    status = (
        F.when(F.col("is_call") & F.col("result").isNotNull(), "linked")
        .when(F.col("is_call"), "unanswered")
        .when(F.col("number") == 0, "orphan")
        .otherwise("repeated")
    )
    json = F.to_json(
        F.struct(
            "after",
            F.try_parse_json("arguments").alias("arguments"),
            F.col("conversation").alias("conversation"),
            "id",
            "name",
            F.col("result.content").alias("result"),
        )
    )
    told = acted.select(
        "conversation",
        "id",
        status.alias("status"),
        "depth",
        "turn",
        F.col("result.turn").alias("result_turn"),
        problems.alias("problems"),
        (F.coalesce("is_call", F.lit(False)) & (F.size(problems) == 0)).alias("valid"),
        json.alias("json"),
    )
    order = [F.col("depth").asc_nulls_last(), F.coalesce("turn", "result_turn").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("json")]
    ordered = numbered(told, "conversation", order, "position")
    plain = rows.where("result IS NULL AND (calls IS NULL OR size(calls) = 0)").select(
        "conversation",
        F.lit("message").alias("status"),
        "turn",
        F.array().cast("array<string>").alias("problems"),
        F.lit(False).alias("valid"),
        F.to_json(F.struct(F.col("text").alias("content"), "conversation", "role")).alias("json"),
    )
    out = ordered.unionByName(plain, allowMissingColumns=True)
    return out.select(
        F.col("conversation").alias(conversation), "id", "status", F.col("position").cast("long").alias("position"), "depth", "turn", "result_turn",
        "problems", "valid", "json",
    )


def in_order(linked: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The rows of `link_calls` in ranges of conversation and position, each sorted, messages last: what a writer stores."""
    keys = (conversation, F.col("position").asc_nulls_last(), F.col("turn"))
    return linked.repartitionByRange(partitions(linked.sparkSession), *keys).sortWithinPartitions(*keys)
