"""Operator 2: tool-call linking for chat formatting, in DataFrame operations only.

Calls and results are joined by (scope, identifier).  A call may name the calls whose
results it uses; its level is its depth in these dependencies, found by pointer
doubling, and calls on a cycle or behind one have none.  So (level, id) is a
topological order.  Arguments are parsed to variants and
checked against JSON schemas turned to column expressions.  Canonical JSON has
sorted keys and no white space; it is what ``to_json`` gives of a variant.

Rows stay rows: nothing is gathered by conversation, so one conversation may
hold any share of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stash

_TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def canonical_json(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it is no JSON (or names a key twice)."""
    return F.to_json(F.try_parse_json(json))


def schema_errors(value: Column, schema: dict | bool, at: str = "$") -> Column:
    """An array of the places, as text, where a variant breaks a JSON schema.

    Read are KEYWORDS; NOTES say nothing of validity and are passed over; any other keyword is
    refused with a ValueError, so that no rule is silently left out.  An integer is a
    number without a fractional part, so 1.0 is one.  items holds for all items of an array.
    """
    none = F.array().cast("array<string>")
    if isinstance(schema, bool):
        return none if schema else F.array(F.lit(f"{at}: false"))
    unknown = set(schema) - KEYWORDS - NOTES
    if unknown:
        raise ValueError(f"{at}: schema keywords that are not read: {', '.join(sorted(unknown))}")
    kind = F.schema_of_variant(value)
    text, number, json = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double"), F.to_json(value)
    is_text, is_number, is_array, is_object = (kind.rlike(_TYPES[t]) for t in ("string", "number", "array", "object"))
    whole = {"integer": is_number & (number == F.rint(number))}
    # branches are guarded: what is no array, or no object, has size 0
    size = F.when(is_array, F.json_array_length(json)).when(is_object, F.size(F.json_object_keys(json))).otherwise(0)
    checks: list[tuple[str, Column]] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for n in names:
            fits = fits | whole.get(n, kind.rlike(_TYPES[n]))
        checks.append(("type", fits))
    if "enum" in schema:
        checks.append(("enum", json.isin([_json(e) for e in schema["enum"]])))
    if "const" in schema:
        checks.append(("const", json == _json(schema["const"])))
    rules = {
        "minLength": (is_text, lambda v: F.length(text) >= v),
        "maxLength": (is_text, lambda v: F.length(text) <= v),
        "pattern": (is_text, lambda v: text.rlike(v)),
        "minimum": (is_number, lambda v: number >= v),
        "maximum": (is_number, lambda v: number <= v),
        "exclusiveMinimum": (is_number, lambda v: number > v),
        "exclusiveMaximum": (is_number, lambda v: number < v),
        "multipleOf": (is_number, lambda v: number / v == F.rint(number / v)),
        "minItems": (is_array, lambda v: size >= v),
        "maxItems": (is_array, lambda v: size <= v),
        "minProperties": (is_object, lambda v: size >= v),
        "maxProperties": (is_object, lambda v: size <= v),
    }
    checks += [(name, ~when | holds(schema[name])) for name, (when, holds) in rules.items() if name in schema]
    valid = lambda s: F.size(schema_errors(value, s, at)) == 0
    count = lambda name: sum((valid(s).cast("int") for s in schema[name]), F.lit(0))
    checks += [(name, test(count(name))) for name, test in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)) if name in schema]
    if "not" in schema:
        checks.append(("not", ~valid(schema["not"])))
    out = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(f"{at}: {name}")) for name, ok in checks]
    parts = [F.array_compact(F.array(*out)) if out else none]
    parts += [schema_errors(value, s, at) for s in schema.get("allOf", [])]
    for name in schema.get("required", []):
        has = F.try_variant_get(value, f"$['{name}']", "variant").isNotNull()
        parts.append(F.when(~is_object | has, none).otherwise(F.array(F.lit(f"{at}.{name}: required"))))
    for name, inner in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$['{name}']", "variant")
        parts.append(F.when(child.isNull(), none).otherwise(schema_errors(child, inner, f"{at}.{name}")))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        wrong = F.transform(items, lambda item: schema_errors(item, schema["items"], f"{at}[]"))
        parts.append(F.when(is_array, F.array_distinct(F.flatten(wrong))).otherwise(none))
    if schema.get("additionalProperties", True) is not True:
        known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
        more = F.when(is_object, F.array_except(F.json_object_keys(json), known)).otherwise(none)
        if schema["additionalProperties"] is False:
            parts.append(F.when(F.size(more) > 0, F.array(F.lit(f"{at}: additionalProperties"))).otherwise(none))
        else:
            fields = F.try_variant_get(value, "$", "map<string,variant>")
            inner = F.transform(more, lambda name: schema_errors(fields[name], schema["additionalProperties"], f"{at}.*"))
            parts.append(F.array_distinct(F.flatten(inner)))
    return F.concat(*parts)


#: Keywords of a schema that are read, and those that say nothing of validity (fixed names).
KEYWORDS = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "minProperties", "maxProperties"} | {
    "anyOf", "oneOf", "allOf", "not", "required", "properties", "items", "additionalProperties",
}
NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$comment", "$schema", "$id"}
#: All joins by identifier are shuffled hash joins.
HASH = "shuffle_hash"


def _json(value) -> str:
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Stands for an endless chain where levels are compared.
_ENDLESS = 1 << 62


def _depths(known: DataFrame, chosen: DataFrame, largest: int) -> DataFrame:
    """(scope, id, level) of calls that each follow one other call, or none: the length of the chain; null where it never ends.

    Pointers are doubled: after k rounds each skips 2**k calls.  A chain as long as
    the largest scope is endless.
    """
    at = known.join(chosen.hint(HASH), ["scope", "id"], "left").withColumn("level", F.col("ptr").isNotNull().cast("long"))
    at, hops = stash(at, "pointers"), 1
    while hops < 2 * largest and not at.where("ptr is not null").isEmpty():
        hops *= 2
        there = at.select("scope", F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("level").alias("more"))
        moved = at.where("ptr is not null").join(there.hint(HASH), ["scope", "ptr"]).select("scope", "id", F.col("far").alias("ptr"), (F.col("level") + F.col("more")).alias("level"))
        at = stash(moved.unionByName(at.where("ptr is null")), "pointers")
    return at.select("scope", "id", F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, id, level): 0 without dependencies, else one more than the highest of them; null on cycles and behind them.

    edges: (scope, id, after).  Dependencies on calls that are not there do not
    count.  Each call first follows one of its dependencies, of the longest and
    last name; where another turns out higher, it follows that, until none is.
    Chains are measured in as many joins as their length has binary digits.
    """
    known = stash(calls.select("scope", "id").distinct(), "calls")
    edges = edges.join(known.hint(HASH), ["scope", "id"], "left_semi").join(known.withColumnRenamed("id", "after").hint(HASH), ["scope", "after"], "left_semi")
    edges = stash(edges.select("scope", "id", "after").distinct(), "edges")
    largest = known.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chosen = edges.groupBy("scope", "id").agg(F.max(F.struct(F.length("after"), "after"))["after"].alias("ptr"))
    while True:
        depths = _depths(known, chosen, largest)
        top = F.coalesce("level", F.lit(_ENDLESS))
        best = edges.join(depths.select("scope", F.col("id").alias("after"), top.alias("top")).hint(HASH), ["scope", "after"])
        best = best.groupBy("scope", "id").agg(F.max(F.struct("top", "after")).alias("best"))
        higher = best.join(depths.hint(HASH), ["scope", "id"]).where(F.col("best.top") >= F.col("level"))
        higher = stash(higher.select("scope", "id", F.col("best.after").alias("other")), "higher")
        if higher.isEmpty():
            return depths
        chosen = stash(chosen.join(higher.hint(HASH), ["scope", "id"], "left").select("scope", "id", F.coalesce("other", "ptr").alias("ptr")), "chosen")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call: its level, results, validity and canonical JSON.

    calls: scope, id, name, arguments (JSON text), after (array of call ids, may be null).
    results: scope, id (of the call), content.  Returns scope, id, name, level,
    n_results, errors, valid and json ({"arguments","id","name"}).

    Calls of one (scope, id) each keep a row and share level and results.  A null scope
    or id links with nothing (level 0, no results).  Null or broken arguments
    give the error "$: json"; a tool without a schema gives "$: unknown tool".
    Results are counted here; :func:`messages` has them, with those without a call.
    """
    edges = calls.where(F.col("after").isNotNull()).select("scope", "id", F.explode("after").alias("after")).where("after is not null")
    level = levels(calls.where("scope is not null and id is not null"), edges)
    counts = results.where("scope is not null and id is not null").groupBy("scope", "id").agg(F.count("*").alias("n_results"))
    value = F.try_parse_json(F.col("arguments"))
    errors = F.array(F.lit("$: unknown tool"))
    for name, schema in schemas.items():
        errors = F.when(F.col("name") == name, schema_errors(value, schema)).otherwise(errors)
    errors = F.when(value.isNull(), F.array(F.lit("$: json"))).otherwise(errors)
    rows = calls.select("scope", "id", "name", "arguments").withColumn("errors", errors)
    joined = rows.join(level.hint(HASH), ["scope", "id"], "left").join(counts.hint(HASH), ["scope", "id"], "left")
    alone = F.col("scope").isNull() | F.col("id").isNull()
    text = F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"id":'), _quoted("id"), F.lit(',"name":'), _quoted("name"), F.lit("}"))
    return joined.select(
        "scope", "id", "name", F.when(alone, 0).otherwise(F.col("level")).alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "errors", (F.size("errors") == 0).alias("valid"), text.alias("json")
    )


def messages(linked: DataFrame, results: DataFrame) -> DataFrame:
    """The messages of a chat: one row for each call, from :func:`link`, and one for each result, with its content.

    Returns scope, id (of the call), role (call or result), level, linked and json;
    a result's is {"content","id","role"}.  A result has its call's level; one without a call
    is not linked and has none.  A call is linked if it has results.
    """
    calls = linked.select("scope", "id", F.lit("call").alias("role"), "level", (F.col("n_results") > 0).alias("linked"), "json")
    text = F.concat(F.lit('{"content":'), _quoted("content"), F.lit(',"id":'), _quoted("id"), F.lit(',"role":"tool"}'))
    named = F.col("scope").isNotNull() & F.col("id").isNotNull()
    rows = results.select("scope", "id", F.lit("result").alias("role"), text.alias("json"))
    level = linked.where(named).select("scope", "id", "level", F.lit(True).alias("there")).distinct()
    joined = rows.where(named).join(level.hint(HASH), ["scope", "id"], "left")
    joined = joined.select("scope", "id", "role", "level", F.coalesce("there", F.lit(False)).alias("linked"), "json")
    alone = rows.where(~named).select("scope", "id", "role", F.lit(None).cast(linked.schema["level"].dataType).alias("level"), F.lit(False).alias("linked"), "json")
    return calls.unionByName(joined).unionByName(alone)


def unmatched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call isn't there."""
    return results.join(calls.select("scope", "id").distinct().hint(HASH), ["scope", "id"], "left_anti")


def _quoted(column: str) -> Column:
    """A value as a JSON string."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(value.alias("a"))), '^\\{"a":|\\}$', ""))


#: The tool that a turn of a conversation calls, by its role, and its arguments' schema.
TURN_SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}}},
    "instruct": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}


def _conversation(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text).

    A turn of the user calls ``ask``, one of the system ``instruct``; the assistant's
    turn is the result of the turn before it.  A call uses the results of the
    two turns before it that are calls.  Rows with a null conv_id or turn have no identifier.
    """
    ident = lambda turn: F.when(turn.isNotNull() & F.col("conv_id").isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))
    t = F.col("turn")
    args = F.to_json(F.struct(t.alias("turn"), F.col("text").alias("text")))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        F.col("conv_id").cast("string").alias("scope"), ident(t).alias("id"), F.when(F.col("role") == "user", "ask").otherwise("instruct").alias("name"), args.alias("arguments"), F.array(ident(t - 1), ident(t - 2)).alias("after")
    )
    return calls, turns.where(F.col("role") == "assistant").select(F.col("conv_id").cast("string").alias("scope"), ident(t - 1).alias("id"), F.col("text").alias("content"))


def conversation_calls(turns: DataFrame) -> DataFrame:
    """:func:`link` and :func:`messages` of a table of turns, a row for each call and each result.

    Results have no name, errors or results of their own; they are valid where their call is there.
    """
    calls, results = _conversation(turns)
    linked = stash(link(calls, results, TURN_SCHEMAS), "linked")
    own = linked.select("scope", "id", F.lit("call").alias("role"), "name", "level", "n_results", F.array_join("errors", ";").alias("errors"), "valid", "json")
    theirs = messages(linked, results).where("role = 'result'")
    theirs = theirs.select("scope", "id", "role", F.lit("").alias("name"), "level", F.lit(0).cast("long").alias("n_results"), F.lit("").alias("errors"), F.col("linked").alias("valid"), "json")
    out = own.unionByName(theirs)
    return out.select(F.col("scope").cast("long").alias("conv_id"), *[c if c != "level" else F.col("level").cast("int").alias("level") for c in out.columns[1:]])


CALLS = """
with recursive c as (
  select conv_id, turn, conv_id::varchar || ':' || turn::varchar as id, case role when 'user' then 'ask' else 'instruct' end as name, text
  from conversations where role in ('user', 'system')
), r as (
  select conv_id, turn - 1 as turn, count(*) as n from conversations where role = 'assistant' group by all
), walk as (
  select distinct conv_id, turn, 0 as level from c
  union
  select c.conv_id, c.turn, walk.level + 1 from c join walk on c.conv_id = walk.conv_id and c.turn - walk.turn in (1, 2)
), lev as (
  select conv_id, turn, max(level) as level from walk group by all
), e as (
  select c.*, list_filter([
    case when text is null then '$.text: required' end,
    case when length(text) < 1 then '$.text: minLength' end,
    case when length(text) > case name when 'ask' then 1000 else 300 end then '$.text: maxLength' end,
    case when turn < 0 then '$.turn: minimum' end,
    case when name = 'instruct' and turn > 0 then '$.turn: maximum' end], lambda x: x is not null) as errors
  from c
)
select e.conv_id, e.id, e.name, lev.level::int as level, coalesce(r.n, 0)::bigint as n_results, array_to_string(errors, ';') as errors, len(errors) = 0 as valid,
       '{"arguments":' || case when text is null then to_json({'turn': e.turn}) else to_json({'text': text, 'turn': e.turn}) end || ',"id":' || to_json(e.id) || ',"name":' || to_json(e.name) || '}' as json
from e join lev using (conv_id, turn) left join r using (conv_id, turn)
"""

ORACLE = f"""
with calls as ({CALLS}), level as (
  select distinct id, level from calls
), r as (
  select conv_id, conv_id::varchar || ':' || (turn - 1)::varchar as id, text from conversations where role = 'assistant'
)
select conv_id, id, 'call' as role, name, level, n_results, errors, valid, json from calls
union all
select r.conv_id, r.id, 'result', '', level.level, 0, '', level.id is not null,
       '{{"content":' || coalesce(to_json(r.text)::varchar, 'null') || ',"id":' || to_json(r.id) || ',"role":"tool"}}'
from r left join level using (id)
"""
