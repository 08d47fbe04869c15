"""Chat formatting with linked tool calls.

Calls stand in an assistant's message as ``<tool_call>{"id", "name",
"arguments"}</tool_call>`` blocks, or the whole message is an object with
``tool_calls``; results stand in ``<tool_result id="...">...</tool_result>``
blocks, or a tool's whole message is an object with ``tool_call_id`` and
``content``. Calls and results meet in a hash join by (conversation,
identifier). Arguments may hold ``${id}`` or ``${id.path}``, the result of
another call; calls are ordered by such references. Arguments are checked
against the tool's schema, and each message is written as canonical JSON: keys
sorted, no blanks, shortest numbers.

No conversation is gathered in one task: chains of calls with one reference
each are followed by doubling their pointers, and only calls with several
references are ordered round by round.

Defined cases: of calls with one identifier in a conversation the first (by
turn, then role and text) is linked and the others are errors, likewise for
results; a result without a call is an orphan; a reference to a call that does
not exist, or a circle of references, is an error of the call and gives it no
level; JSON that is not valid, holds numbers beyond finite doubles, characters
that UTF-8 cannot write or more than ``DEPTH`` levels makes the call malformed;
a null text is null content; a very long text is parsed whole; null
conversations form one conversation; repeated rows are written each, and one of
them counts as the first; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common

#: Tools that calls are checked against unless others are given.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "additionalProperties": False},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string", "pattern": "^https?://"}, "timeout": {"type": "number", "minimum": 0}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}, "digits": {"type": "integer", "minimum": 0, "maximum": 30}}, "additionalProperties": False},
}
_CALL, _CALL_END = re.compile("<tool_call>"), "</tool_call>"
_RESULT, _RESULT_END = re.compile(r"<tool_result\s+id=\"([^\"]*)\"\s*>"), "</tool_result>"
_REFERENCE = re.compile(r"\$\{([A-Za-z0-9_-]+)[^}]*\}")
#: Levels of nesting that JSON may have.
DEPTH = 100
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    def plain(v):
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                return None
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_KNOWN = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "properties", "required",
    "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "anyOf", "oneOf", "allOf", "title", "description", "default", "examples",
}


def check_schema(schema: dict, at: str = "$") -> None:
    """Raise if ``schema`` has a keyword that ``validate`` would pass over."""
    if extra := set(schema) - _KNOWN:
        raise ValueError(f"{at}: schema keywords that are not supported: {', '.join(sorted(extra))}")
    for name, inner in schema.get("properties", {}).items():
        check_schema(inner, f"{at}.{name}")
    for kind in ("anyOf", "oneOf", "allOf"):
        for inner in schema.get(kind, ()):
            check_schema(inner, at)
    for kind in ("items", "additionalProperties"):
        if isinstance(schema.get(kind), dict):
            check_schema(schema[kind], f"{at}[]")


def _bounds(value, size, schema: dict, at: str) -> list[str]:
    errors = []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        tests = (("minimum", value < schema.get("minimum", value), "below minimum"), ("maximum", value > schema.get("maximum", value), "above maximum"))
        errors += [f"{at}: {says}" for _, fails, says in tests if fails]
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            errors.append(f"{at}: below minimum")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            errors.append(f"{at}: above maximum")
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
    if size is not None:
        if size < schema.get(low, 0):
            errors.append(f"{at}: too short")
        if size > schema.get(high, size):
            errors.append(f"{at}: too long")
    return errors


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` does against ``schema``: types, enums, bounds, patterns, properties, items and alternatives."""
    kind, errors = schema.get("type"), []
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not number or (kind == "integer" and value != int(value)):
            return [f"{at}: not {kind}"]
    elif kind is not None and not isinstance(value, _KINDS[kind]):
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        errors.append(f"{at}: not the constant")
    errors += _bounds(value, len(value) if isinstance(value, (str, list)) else None, schema, at)
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        errors.append(f"{at}: pattern")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        errors += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += validate(value[k], known[k], f"{at}.{k}")
            elif more is False:
                errors.append(f"{at}.{k}: unknown")
            elif isinstance(more, dict):
                errors += validate(value[k], more, f"{at}.{k}")
    if isinstance(value, list):
        if "items" in schema:
            errors += [e for i, x in enumerate(value) for e in validate(x, schema["items"], f"{at}[{i}]")]
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            errors.append(f"{at}: repeated items")
    for inner in schema.get("allOf", ()):
        errors += validate(value, inner, at)
    if "anyOf" in schema and all(validate(value, s, at) for s in schema["anyOf"]):
        errors.append(f"{at}: none of the alternatives")
    if "oneOf" in schema and sum(not validate(value, s, at) for s in schema["oneOf"]) != 1:
        errors.append(f"{at}: not one of the alternatives")
    return errors


def _sound(value) -> bool:
    """Whether all numbers are finite, all strings can be written as UTF-8 and nesting is bounded."""
    todo = [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if depth > DEPTH:
            return False
        if isinstance(v, str):
            if not v.isascii() and any("\ud800" <= c <= "\udfff" for c in v):
                return False
        elif isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                return False
        elif isinstance(v, dict):
            todo += [(x, depth + 1) for pair in v.items() for x in pair]
        elif isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
    return True


def _object(text: str) -> dict | None:
    """The JSON object that ``text`` is, if it is one and sound."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and _sound(found) else None


def _blocks(text: str, opening: re.Pattern, end: str) -> tuple[str, list[tuple[re.Match, str]]]:
    """The text without its blocks, and each block's opening and inside; a time in proportion to the text."""
    left, found, at = [], [], 0
    while m := opening.search(text, at):
        stop = text.find(end, m.end())
        if stop < 0:
            break
        left.append(text[at : m.start()])
        found.append((m, text[m.end() : stop]))
        at = stop + len(end)
    return "".join([*left, text[at:]]), found


def parse(role: str | None, text: str | None, tools: dict[str, dict]) -> tuple[str | None, list[dict], list[dict]]:
    """A message's content without its blocks, its calls and its results."""
    if text is None:
        return None, [], []
    content, raw, results = text, [], []
    whole = _object(text) if text[:1] == "{" else None
    if whole is not None and role == "assistant" and isinstance(whole.get("tool_calls"), list):
        content = whole.get("content") if isinstance(whole.get("content"), str) else ""
        for c in whole["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            f = c["function"] if isinstance(c.get("function"), dict) else c
            raw.append({"id": c.get("id"), "name": f.get("name"), "arguments": f.get("arguments")})
    elif whole is not None and role == "tool" and "tool_call_id" in whole:
        content = ""
        results.append({"id": str(whole["tool_call_id"]), "content": canonical(whole.get("content"))})
    else:
        if role == "assistant":
            content, found = _blocks(text, _CALL, _CALL_END)
            raw = [_object(inside) or {"broken": True} for _, inside in found]
        content, found = _blocks(content, _RESULT, _RESULT_END)
        results = [{"id": m[1], "content": inside} for m, inside in found]
    calls = []
    for c in raw:
        arguments = c.get("arguments")
        if isinstance(arguments, str):
            arguments = _object(arguments)
        errors = []
        if c.get("broken") or not isinstance(c.get("id"), (str, int)) or not isinstance(c.get("name"), str):
            errors.append("malformed call")
        elif c["name"] not in tools:
            errors.append("unknown tool")
        elif not isinstance(arguments, dict):
            errors.append("arguments are not an object")
        else:
            errors += validate(arguments, tools[c["name"]])
        written = canonical(arguments if isinstance(arguments, dict) else {})
        calls.append({"id": None if c.get("id") is None else str(c["id"]), "name": str(c.get("name") or ""), "arguments": written, "refs": list(dict.fromkeys(_REFERENCE.findall(written))), "errors": errors})
    return content, calls, results


_CALLS = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))]))
_RESULTS = pa.list_(pa.struct([("id", pa.string()), ("content", pa.string())]))
_PARSED = "mid long, conv_id long, turn long, role string, content string, calls array<struct<id: string, name: string, arguments: string, refs: array<string>, errors: array<string>>>, results array<struct<id: string, content: string>>, h long"


def _parser(tools: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, calls, results = [], [], []
            for role, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                for out, part in zip((content, calls, results), parse(role, text, tools), strict=True):
                    out.append(part)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(content, pa.string()), pa.array(calls, _CALLS), pa.array(results, _RESULTS), b.column(5)], names=["mid", "conv_id", "turn", "role", "content", "calls", "results", "h"])

    return run


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: 0 without references, else one more than the highest level referred to; none in circles or before them.

    ``edges`` (node, ref) refer to ``nodes`` only. Pointers of nodes with one
    reference are doubled until they reach a node with none or several, so a
    chain of n takes log n rounds; then nodes with several references are done
    in the order of their depth among each other.
    """
    edges = common.staged(edges.distinct(), "chat-edges")
    degree = common.staged(edges.groupBy("node").agg(F.count("*").alias("n"), F.min("ref").alias("to")), "chat-degrees")
    single = common.staged(degree.filter("n = 1").select("node", "to", F.lit(1).cast("long").alias("w")), "chat-chains")
    left = single.count()
    for _ in range(left.bit_length()):
        ahead = single.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
        moved = single.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("next").isNotNull().alias("going"))
        moved = common.staged(moved, "chat-chains")
        single, going = moved.drop("going"), moved.filter("going").count()
        if not going:
            break
    # a pointer that still points at a node of one reference runs in a circle
    several = degree.filter("n > 1").select("node")
    ends = single.join(degree.filter("n = 1").select(F.col("node").alias("to")), "to", "left_anti")
    ends = common.staged(ends, "chat-ends")
    e = edges.join(several, "node", "left_semi").select("node", F.col("ref").alias("r"))
    e = e.join(ends.select(F.col("node").alias("r"), "to", "w"), "r", "left").join(degree.select(F.col("node").alias("r"), "n"), "r", "left")
    # targets of several references are waited for; a chain into a circle waits for its own node, that is for ever
    target = F.when(F.col("to").isNotNull(), F.col("to")).when(F.col("n") == 1, F.col("node")).otherwise(F.col("r"))
    e = e.select("node", target.alias("to"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
    e = e.join(several.select(F.col("node").alias("to"), F.lit(True).alias("waits")), "to", "left").select("node", "to", "w", F.when(F.col("waits").isNull(), F.lit(0).cast("long")).alias("got"))
    e, done = common.staged(e, "chat-waits"), None
    while True:
        ready = common.staged(e.groupBy("node").agg(F.count(F.when(F.col("got").isNull(), 1)).alias("open"), F.max(F.col("w") + F.col("got")).alias("level")).filter("open = 0").select("node", "level"), "chat-ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        told = ready.select(F.col("node").alias("to"), F.col("level").alias("new"))
        e = common.staged(e.join(ready, "node", "left_anti").join(told, "to", "left").select("node", "to", "w", F.coalesce("got", "new").alias("got")), "chat-waits")
    none = nodes.select("node").join(degree, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))
    found = none if done is None else none.unionByName(done)
    found = common.staged(found, "chat-levels")
    chained = ends.join(found.withColumnRenamed("node", "to"), "to").select("node", (F.col("w") + F.col("level")).alias("level"))
    return found.unionByName(chained)


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            calls = sorted(r["calls"] or [], key=lambda c: c["k"])
            message: dict = {"role": r["role"], "content": r["content"]}
            if calls:
                message["tool_calls"] = [
                    {"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "level": c["level"], "result": c["result"], "errors": c["errors"]} for c in calls
                ]
            if r["results"]:
                message["tool_results"] = [{"id": x["id"], "content": x["content"], "orphan": x["orphan"], "repeated": x["repeated"]} for x in sorted(r["results"], key=lambda x: x["k"])]
            text = canonical(message)
            errors = [f"{'?' if c['id'] is None else c['id']}: {e}" for c in calls for e in c["errors"]]
            out.append((r["conv_id"], r["turn"], r["role"], len(calls), len(r["results"] or []), sum(c["result"] is not None for c in calls), sum(x["orphan"] for x in r["results"] or []), "; ".join(errors), text, hashlib.sha256(text.encode()).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(10)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["conv_id", "turn", "role", "n_calls", "n_results", "n_linked", "n_orphans", "errors", "json", "json_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def format_chats(conversations: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: counts, errors, its canonical JSON and that text's digest."""
    tools = TOOLS if tools is None else tools
    for schema in tools.values():
        check_schema(schema)
    m = conversations.select(
        F.monotonically_increasing_id().alias("mid"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
        F.xxhash64(F.col("role").cast("string"), F.col("text").cast("string")).alias("h"),
    )
    m = common.staged(m.mapInArrow(_parser(tools), _PARSED), "chat-parsed")
    node = lambda i: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), i)
    at = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", "h", "mid", "k")
    calls = m.select("conv_id", "turn", "mid", "h", F.posexplode("calls").alias("k", "c")).select(node(F.col("c.id")).alias("node"), at.alias("at"), "mid", "k", "c.*")
    results = m.select("conv_id", "turn", "mid", "h", F.posexplode("results").alias("k", "r")).select(node(F.col("r.id")).alias("node"), at.alias("at"), "mid", "k", "conv_id", "r.*")
    calls, results = common.staged(calls, "chat-calls"), common.staged(results, "chat-results")
    first_call = calls.filter("node IS NOT NULL").groupBy("node").agg(F.min("at").alias("call_at"), F.min_by("refs", "at").alias("refs"))
    first_call = common.staged(first_call, "chat-first-calls")
    first_result = results.filter("node IS NOT NULL").groupBy("node").agg(F.min("at").alias("result_at"), F.min_by("content", "at").alias("result"))

    refs = first_call.select("node", F.explode("refs").alias("name")).withColumn("ref", F.concat(F.substring_index("node", ":", 1), F.lit(":"), "name"))
    known = common.staged(refs.join(first_call.select(F.col("node").alias("ref"), F.lit(True).alias("there")), "ref", "left"), "chat-references")
    gone = known.filter("there IS NULL").groupBy("node").agg(F.sort_array(F.collect_set("name")).alias("gone"))
    level = levels(first_call, known.filter("there").select("node", "ref"))
    about = first_call.drop("refs").join(first_result, "node", "full_outer").join(level, "node", "left").join(gone, "node", "left")
    about = common.staged(about, "chat-identifiers")

    none = F.array().cast("array<string>")
    nameless = calls.filter("node IS NULL").select("mid", F.struct("k", "id", "name", "arguments", F.lit(None).cast("long").alias("level"), F.lit(None).cast("string").alias("result"), "errors").alias("c"))
    d = common.looked_up(calls.filter("node IS NOT NULL"), about, "node")
    first = F.col("at") == F.col("call_at")
    errors = F.concat(
        "errors",
        F.when(~first, F.array(F.lit("repeated identifier"))).otherwise(none),
        F.coalesce(F.transform("gone", lambda x: F.concat(F.lit("refers to nothing: "), x)), none),
        F.when(first & F.col("level").isNull(), F.array(F.lit("circular references"))).otherwise(none),
    )
    linked = first & F.col("gone").isNull()
    d = d.select("mid", F.struct("k", "id", "name", "arguments", F.when(linked, F.col("level")).alias("level"), F.when(first, F.col("result")).alias("result"), errors.alias("errors")).alias("c"))
    d = d.unionByName(nameless).groupBy("mid").agg(F.collect_list("c").alias("calls"))
    r = common.looked_up(results, about.select("node", "call_at", "result_at"), "node")
    r = r.select("mid", F.struct("k", "id", "content", F.col("call_at").isNull().alias("orphan"), (F.col("at") != F.col("result_at")).alias("repeated")).alias("r"))
    r = r.groupBy("mid").agg(F.collect_list("r").alias("results"))
    out = m.select("mid", "conv_id", "turn", "role", "content").join(d, "mid", "left").join(r, "mid", "left").drop("mid")
    ddl = "conv_id long, turn long, role string, n_calls long, n_results long, n_linked long, n_orphans long, errors string, json string, json_sha256 string"
    return out.select("conv_id", "turn", "role", "content", "calls", "results").mapInArrow(_writer, ddl)


# ---- calls for tables that hold none

def _case(k: int, x: str) -> str:
    return f"WHEN {k} THEN {x}"


def with_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with tool calls and results, derived from their numbers.

    Most assistant turns get a call: a plain one, one that refers to the call
    two turns before, or one with a fault (bad or missing arguments, an unknown
    tool, a reference to nothing, a circle, broken JSON, an identifier that
    comes again). User turns hold the result of the call before, some twice or
    not at all, and some a result that nobody asked for.
    """
    call = lambda i, name, arguments: f"concat('<tool_call>{{\"id\":\"', {i}, '\",\"name\":\"{name}\",\"arguments\":', {arguments}, '}}</tool_call>')"
    own, twin = "concat('c', turn, 'a')", "concat('c', turn, 'b')"
    tag = "concat(conv_id, '-', turn)"
    told = "CASE WHEN turn >= 3 THEN concat('$', '{c', turn - 2, 'a.value} + ', turn) ELSE concat('1 + ', turn) END"
    cases = [
        call(own, "search", f"concat('{{\"query\": \"', {tag}, '\", \"limit\": ', turn + 1, '.0}}')"),
        call(own, "fetch", f"concat('{{\"url\": \"https://example.org/', {tag}, '\"}}')"),
        call(own, "calculate", f"concat('{{\"expression\": \"', {told}, '\"}}')"),
        call(own, "search", f"concat('{{\"query\":\"', {tag}, '\",\"limit\":0}}')"),
        call(own, "weather", "'{}'"),
        call(own, "search", f"concat('\"{{\\\\\"query\\\\\":\\\\\"', {tag}, '\\\\\"}}\"')"),
        call(own, "fetch", "concat('{\"timeout\": 2.50, \"url\": \"http://$', '{gone}\"}')"),
        f"concat({call(own, 'calculate', f"concat('{{\"expression\":\"$', '{{', {twin}, '}}\"}}')")}, {call(twin, 'calculate', f"concat('{{\"expression\":\"$', '{{', {own}, '}}\"}}')")})",
        f"concat('<tool_call>{{\"id\":\"', {own}, '</tool_call>')",
        call("'c1a'", "search", f"concat('{{\"query\":\"', {tag}, '\"}}')"),
        "''",
        call(own, "fetch", "'{\"link\": true}'"),
    ]
    chosen = "pmod(conv_id * 7 + turn * 13, 12)"
    calls = f"CASE {chosen} " + " ".join(_case(k, x) for k, x in enumerate(cases)) + " END"
    result = lambda i, content: f"concat('<tool_result id=\"', {i}, '\">', {content}, '</tool_result>')"
    one = result("concat('c', turn - 1, 'a')", f"concat('found ', {tag})")
    results = f"concat(CASE WHEN {chosen} % 5 <> 0 THEN {one} ELSE '' END, CASE WHEN {chosen} = 4 THEN {one} ELSE '' END, CASE WHEN {chosen} % 4 = 3 THEN {result("concat('x', turn)", "'unasked'")} ELSE '' END)"
    text = f"CASE WHEN role = 'assistant' THEN concat(text, chr(10), {calls}) WHEN role = 'user' AND turn >= 1 THEN concat(text, chr(10), {results}) ELSE text END"
    return conversations.selectExpr("conv_id", "turn", "role", f"coalesce({text}, text) AS text")


def oracle() -> str:
    """DuckDB SQL of ``format_chats(with_calls(conversations))``: the calls as rows, linked and written without parsing."""
    tag = "conv_id || '-' || turn"
    return f"""WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, (conv_id * 7 + turn * 13) % 12 AS k FROM conversations),
c AS (SELECT conv_id, turn, 0 AS i, CASE k WHEN 9 THEN 'c1a' WHEN 8 THEN NULL ELSE 'c' || turn || 'a' END AS id,
CASE WHEN k IN (0, 3, 5, 9) THEN 'search' WHEN k IN (1, 6, 11) THEN 'fetch' WHEN k IN (2, 7) THEN 'calculate' WHEN k = 4 THEN 'weather' ELSE '' END AS name,
CASE k WHEN 0 THEN '{{"limit":' || (turn + 1) || ',"query":"' || {tag} || '"}}' WHEN 1 THEN '{{"url":"https://example.org/' || {tag} || '"}}'
WHEN 2 THEN CASE WHEN turn >= 3 THEN '{{"expression":"${{c' || (turn - 2) || 'a.value}} + ' || turn || '"}}' ELSE '{{"expression":"1 + ' || turn || '"}}' END
WHEN 3 THEN '{{"limit":0,"query":"' || {tag} || '"}}' WHEN 5 THEN '{{"query":"' || {tag} || '"}}' WHEN 6 THEN '{{"timeout":2.5,"url":"http://${{gone}}"}}' WHEN 7 THEN '{{"expression":"${{c' || turn || 'b}}"}}'
WHEN 9 THEN '{{"query":"' || {tag} || '"}}' WHEN 11 THEN '{{"link":true}}' ELSE '{{}}' END AS args,
CASE k WHEN 3 THEN ['$.limit: below minimum'] WHEN 4 THEN ['unknown tool'] WHEN 8 THEN ['malformed call'] WHEN 11 THEN ['$.url: missing', '$.link: unknown'] ELSE CAST([] AS VARCHAR[]) END AS faults,
CASE WHEN k = 2 AND turn >= 3 THEN 'c' || (turn - 2) || 'a' WHEN k = 6 THEN 'gone' WHEN k = 7 THEN 'c' || turn || 'b' END AS ref FROM m WHERE role = 'assistant' AND k <> 10
UNION ALL SELECT conv_id, turn, 1, 'c' || turn || 'b', 'calculate', '{{"expression":"${{c' || turn || 'a}}"}}', CAST([] AS VARCHAR[]), 'c' || turn || 'a' FROM m WHERE role = 'assistant' AND k = 7),
r AS (SELECT conv_id, turn, 0 AS i, 'c' || (turn - 1) || 'a' AS id, 'found ' || {tag} AS content FROM m WHERE role = 'user' AND turn >= 1 AND k % 5 <> 0
UNION ALL SELECT conv_id, turn, 1, 'c' || (turn - 1) || 'a', 'found ' || {tag} FROM m WHERE role = 'user' AND turn >= 1 AND k = 4
UNION ALL SELECT conv_id, turn, 2, 'x' || turn, 'unasked' FROM m WHERE role = 'user' AND turn >= 1 AND k % 4 = 3),
cf AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, i) = 1 AS first FROM c),
rf AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, i) = 1 AS first FROM r),
fc AS (SELECT conv_id, id, ref FROM cf WHERE first), fr AS (SELECT conv_id, id, content FROM rf WHERE first),
e AS (SELECT a.conv_id, a.id, a.ref, b.id IS NOT NULL AS known FROM fc a LEFT JOIN fc b ON a.conv_id = b.conv_id AND a.ref = b.id),
lv AS (SELECT conv_id, id, 0 AS level FROM e WHERE ref IS NULL OR NOT known UNION ALL SELECT e.conv_id, e.id, lv.level + 1 FROM e JOIN lv ON e.conv_id = lv.conv_id AND e.ref = lv.id),
d AS (SELECT cf.*, lv.level, fr.content AS result, e.ref IS NOT NULL AND NOT e.known AS gone, e.ref AS missing, cf.id IS NOT NULL AND NOT first AS again
FROM cf LEFT JOIN lv ON cf.conv_id = lv.conv_id AND cf.id = lv.id LEFT JOIN fr ON cf.conv_id = fr.conv_id AND cf.id = fr.id LEFT JOIN e ON cf.conv_id = e.conv_id AND cf.id = e.id),
g AS (SELECT conv_id, turn, i, id, name, args, CASE WHEN first AND NOT gone THEN level END AS level, CASE WHEN first THEN result END AS result,
faults || CASE WHEN again THEN ['repeated identifier'] ELSE [] END || CASE WHEN gone THEN ['refers to nothing: ' || missing] ELSE [] END || CASE WHEN first AND level IS NULL THEN ['circular references'] ELSE [] END AS errors FROM d),
cs AS (SELECT conv_id, turn, count(*) AS n, count(result) AS linked, string_agg(array_to_string([coalesce(id, '?') || ': ' || x for x in errors], '; '), '; ' ORDER BY i) FILTER (len(errors) > 0) AS errors,
string_agg('{{"arguments":' || args || ',"errors":' || to_json(errors) || ',"id":' || coalesce('"' || id || '"', 'null') || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":"' || name || '","result":' || coalesce('"' || result || '"', 'null') || '}}', ',' ORDER BY i) AS js FROM g GROUP BY ALL),
rs AS (SELECT rf.conv_id, rf.turn, count(*) AS n, count(*) FILTER (fc.id IS NULL) AS orphans, string_agg('{{"content":"' || content || '","id":"' || rf.id || '","orphan":' || (fc.id IS NULL) || ',"repeated":' || (NOT first) || '}}', ',' ORDER BY i) AS js
FROM rf LEFT JOIN fc ON rf.conv_id = fc.conv_id AND rf.id = fc.id GROUP BY ALL),
o AS (SELECT m.conv_id, m.turn, role, coalesce(cs.n, 0) AS n_calls, coalesce(rs.n, 0) AS n_results, coalesce(linked, 0) AS n_linked, coalesce(orphans, 0) AS n_orphans, coalesce(errors, '') AS errors,
'{{"content":' || to_json(text || CASE WHEN role = 'assistant' OR (role = 'user' AND m.turn >= 1) THEN chr(10) ELSE '' END) || ',"role":"' || role || '"' || coalesce(',"tool_calls":[' || cs.js || ']', '') || coalesce(',"tool_results":[' || rs.js || ']', '') || '}}' AS json
FROM m LEFT JOIN cs ON m.conv_id = cs.conv_id AND m.turn = cs.turn LEFT JOIN rs ON m.conv_id = rs.conv_id AND m.turn = rs.turn)
SELECT *, sha256(json) AS json_sha256 FROM o"""
