"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import functools
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.tables import cut, parts, table

#: Calls ordered together in one task, and calls of one conversation beyond which rounds of joins order it.
TOGETHER = 20_000

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def schema_errors(value, schema: dict, where: str = "$") -> list[str]:
    """What in ``value`` breaks the schema: type, enum, required, properties, additionalProperties, items, limits."""
    out = []
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{where}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{where}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{where}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{where}: above maximum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{where}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{where}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{where}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{where}[{i}]")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and no escapes but those JSON needs."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_arguments(text: str | None) -> tuple[object, str | None]:
    """The value of a call's arguments, or why there is none: no JSON, nested too deeply, or no canonical form.

    Numbers beyond the range of doubles and halves of surrogate pairs can be read but not written again.
    """
    try:
        value = json.loads(text or "", parse_constant=_no_constant)
    except ValueError:
        return None, "$: not JSON"
    except RecursionError:
        return None, "$: nested too deeply"
    try:
        canonical([[value]]).encode("utf-8")  # deeper than in the message
    except (ValueError, RecursionError):
        return None, "$: no canonical form"
    return value, None


def levels_of(calls: list[tuple[object, list]]) -> dict:
    """The longest chain of calls below each (Kahn's order); None on a cycle or above one.  Unknown ids do not count."""
    known = {c for c, _ in calls}
    needs = {c: {d for d in deps if d in known} for c, deps in calls}
    users = defaultdict(list)
    for c, deps in needs.items():
        for d in deps:
            users[d].append(c)
    level = {c: None for c in known}
    ready, open_ = [c for c, d in needs.items() if not d], {c: len(d) for c, d in needs.items()}
    for c in ready:
        level[c] = 0
    depth = dict.fromkeys(known, 0)
    while ready:
        c = ready.pop()
        level[c] = depth[c]
        for u in users[c]:
            depth[u] = max(depth[u], depth[c] + 1)
            open_[u] -= 1
            if not open_[u]:
                ready.append(u)
    return level


def _ordered(batch: pa.Table) -> pa.Table:
    calls = defaultdict(list)
    for r in batch.to_pylist():
        calls[r["conv_id"]].append((r["call_id"], r["needs"] or []))
    rows = [(k, c, level) for k, own in calls.items() for c, level in levels_of(own).items()]
    kinds = [batch.schema.field("conv_id").type, pa.string(), pa.int32()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("conv_id", "call_id", "level"), kinds, strict=True))})


def _chains(edges: DataFrame, n: int) -> DataFrame:
    """user, head, far: for every call that needs exactly one other, the first call down its chain that does not, and how far it is.

    Pointers are doubled, so a chain of n calls takes log n rounds.  Where a chain ends in a ring, ``head``
    stays a call that needs one other.
    """
    chains = edges.groupBy("conv_id", "user").agg(F.min("call_id").alias("head"), F.count(F.lit(1)).alias("_needs"))
    chains = cut(chains.where("_needs = 1").select("conv_id", "user", "head", F.lit(1).cast("long").alias("far")))
    for _ in range(n.bit_length() + 1):
        on = chains.select("conv_id", F.col("user").alias("head"), F.col("head").alias("_head"), F.col("far").alias("_far"))
        moved = chains.join(on, ["conv_id", "head"], "left")
        if moved.where("_head is not null").isEmpty():
            break
        chains = cut(moved.select("conv_id", "user", F.coalesce("_head", "head").alias("head"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")))
    return chains


def _by_rounds(calls: DataFrame) -> DataFrame:
    """Levels of the calls of conversations of any size.

    Calls that need one other are contracted to the head of their chain.  Among the rest each round settles
    the calls whose needs are settled, so rounds are as many as the longest path has calls with several
    needs.  What is settled is written once.
    """
    ids = cut(calls.select("conv_id", "call_id"))
    edges = calls.select("conv_id", F.col("call_id").alias("user"), F.explode("needs").alias("call_id")).distinct()
    edges = cut(edges.join(ids, ["conv_id", "call_id"], "left_semi"))
    chains = _chains(edges, ids.count())
    far = chains.select("conv_id", F.col("user").alias("call_id"), "head", "far")
    several = edges.join(chains.select("conv_id", "user"), ["conv_id", "user"], "left_anti").join(far, ["conv_id", "call_id"], "left")
    open_ = cut(several.select("conv_id", "user", F.coalesce("head", "call_id").alias("call_id"), (1 + F.coalesce("far", F.lit(0))).alias("far")))
    level = F.col("level").cast("int").alias("level")
    free = cut(ids.join(edges.select("conv_id", F.col("user").alias("call_id")).distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    settled, best = [], None
    while not free.isEmpty():
        settled.append(free)
        reached = open_.join(free, ["conv_id", "call_id"]).select("conv_id", "user", (F.col("level") + F.col("far")).alias("level"))
        open_ = cut(open_.join(free, ["conv_id", "call_id"], "left_anti"))
        best = reached if best is None else best.union(reached)
        best = cut(best.groupBy("conv_id", "user").agg(F.max("level").alias("level")))
        waiting = open_.select("conv_id", "user").distinct()
        free = cut(best.join(waiting, ["conv_id", "user"], "left_anti").select("conv_id", F.col("user").alias("call_id"), "level"))
        best = cut(best.join(waiting, ["conv_id", "user"], "left_semi"))
    done = functools.reduce(DataFrame.union, settled) if settled else free
    heads = done.select("conv_id", F.col("call_id").alias("head"), "level")
    chained = chains.join(heads, ["conv_id", "head"]).select("conv_id", F.col("user").alias("call_id"), (F.col("level") + F.col("far")).alias("level"))
    return ids.join(done.union(chained), ["conv_id", "call_id"], "left").select("conv_id", "call_id", level)


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of calls (conv_id, call_id, needs): a call comes after all that it needs.

    A level is one more than the highest level needed, 0 without needs, and null on or above a cycle.
    Conversations of up to ``TOGETHER`` calls are ordered in memory, many to a task; longer ones by rounds
    of joins, after chains have been contracted by pointer doubling.
    """
    sizes = calls.groupBy("conv_id").count()
    long = cut(sizes.where(F.col("count") > TOGETHER).select("conv_id"))
    tasks = parts(calls.sparkSession, calls.count(), TOGETHER)
    near = calls.alias("c").join(long.alias("l"), F.col("c.conv_id").eqNullSafe(F.col("l.conv_id")), "left_anti")
    schema = f"conv_id {dict(calls.dtypes)['conv_id']}, call_id string, level int"
    levels = near.withColumn("_task", F.pmod(F.xxhash64("conv_id"), F.lit(tasks))).groupBy("_task").applyInArrow(lambda t: _ordered(t.select(["conv_id", "call_id", "needs"])), schema)
    if long.isEmpty():
        return levels
    far = calls.alias("c").join(long.alias("l"), F.col("c.conv_id").eqNullSafe(F.col("l.conv_id")), "left_semi")
    # nulls as a key of their own, so that the rounds may join on equality
    key = F.coalesce(F.to_json(F.struct(F.col("conv_id").alias("k"))), F.lit("{}"))
    settled = _by_rounds(far.select(key.alias("conv_id"), "call_id", "needs"))
    return levels.union(settled.select(F.from_json("conv_id", f"k {dict(calls.dtypes)['conv_id']}")["k"].alias("conv_id"), "call_id", "level"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a call or result without a call: linked, ordered, validated and serialised.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON) and needs (ids of calls whose results it
    uses); ``results`` has conv_id, turn, call_id, content.  Calls and results are hash-joined by
    conversation and identifier.  Of several calls (or results) with one identifier the first by turn
    counts, then by content, and ``n_calls``/``n_results`` tell how many there were.  A result before its
    call is ``early``.  A null conversation is a conversation; rows with a null call_id are ``unnamed``
    and are neither linked nor ordered.  Arguments that are no JSON object, are nested too deeply, have no
    canonical form (``1e999``, half a surrogate pair), break their schema or name no known tool have errors;
    those that cannot be read or written again stand in the JSON as the text they are.  Schemas hold no
    references, so checking goes no deeper than they do.

    Returns conv_id, level (null: on or above a cycle, or no call), turn, call_id, status (linked, open,
    orphan, early, unnamed), n_calls, n_results, errors, json (canonical; sort by level and turn).
    """
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.call_id") == F.col(f"{b}.call_id"))
    named = calls.where("call_id is not null").select("conv_id", "call_id", F.struct("turn", "name", "arguments", "needs").alias("v"))
    first = named.groupBy("conv_id", "call_id").agg(F.min("v").alias("call"), F.count(F.lit(1)).alias("n_calls"))
    answers = results.where("call_id is not null").select("conv_id", "call_id", F.struct("turn", "content").alias("v"))
    answer = answers.groupBy("conv_id", "call_id").agg(F.min("v").alias("result"), F.count(F.lit(1)).alias("n_results"))
    levels = call_levels(cut(first.select("conv_id", "call_id", F.col("call.needs").alias("needs"))))
    placed = first.alias("f").join(levels.alias("l"), same("f", "l"), "left").select("f.*", "l.level")
    pairs = placed.alias("a").join(answer.alias("b"), same("a", "b"), "full").select(
        F.coalesce("a.conv_id", "b.conv_id").alias("conv_id"), F.coalesce("a.call_id", "b.call_id").alias("call_id"), "level", "call", "result",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )
    void = lambda c: F.lit(None).cast(dict(pairs.dtypes)[c])
    unnamed = calls.where("call_id is null").select("conv_id", void("call_id").alias("call_id"), void("level").alias("level"), F.struct("turn", "name", "arguments", "needs").alias("call"), void("result").alias("result"), F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results")).union(
        results.where("call_id is null").select("conv_id", void("call_id"), void("level"), void("call"), F.struct("turn", "content"), F.lit(0).cast("long"), F.lit(1).cast("long"))
    )
    rows = pairs.union(unnamed).select(
        "conv_id", "level", F.coalesce("call.turn", "result.turn").alias("turn"), "call_id", _status().alias("status"), "n_calls", "n_results",
        F.col("call").isNotNull().alias("_called"), F.col("call.name").alias("_name"), F.col("call.arguments").alias("_arguments"), F.col("result.content").alias("_content"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, lines = [], []
            for r in batch.select(["call_id", "_called", "_name", "_arguments", "_content"]).to_pylist():
                arguments, own = r["_arguments"], []
                if r["_called"]:
                    value, wrong = read_arguments(arguments)
                    if wrong:
                        own = [wrong]
                    else:
                        arguments = value
                        own = schema_errors(value, {"type": "object"} | schemas[r["_name"]]) if r["_name"] in schemas else ["$: no such tool"]
                message = {"id": r["call_id"], "name": r["_name"], "arguments": arguments, "result": r["_content"]}
                errors.append(own)
                lines.append(canonical({k: v for k, v in message.items() if v is not None}))
            keep = batch.select([c for c in batch.schema.names if not c.startswith("_")])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())], [*keep.schema.names, "errors", "json"])

    head = ", ".join(f"{n} {t}" for n, t in rows.dtypes if not n.startswith("_"))
    return rows.mapInArrow(run, f"{head}, errors array<string>, json string")


def _status() -> Column:
    return (
        F.when(F.col("call_id").isNull(), "unnamed")
        .when(F.col("call").isNull(), "orphan")
        .when(F.col("result").isNull(), "open")
        .when(F.col("result.turn") < F.col("call.turn"), "early")
        .otherwise("linked")
    )


#: What the calls that the query derives from conversations may be.
CONVERSATION_TOOLS = {
    "answer": {
        "required": ["question", "words"],
        "properties": {"question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}, "after": {"type": "string"}},
        "additionalProperties": False,
    },
    "instruct": {"required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of turns: a user's or system turn calls, an assistant's turn answers the one before.

    A user's turn needs the answer to the user's turn two before.  A turn with another role, or none, is a
    result without identifier, so it comes out as ``unnamed``; as does any turn without a number.
    """
    turn = F.col("turn").cast("string")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string")))
    asked = F.to_json(F.struct(F.col("text").alias("question"), words.alias("words"), after.alias("after")))
    told = F.to_json(F.struct("text"))
    user = F.col("role") == "user"
    calls = messages.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.concat(F.lit("turn-"), turn).alias("call_id"), F.when(user, "answer").otherwise("instruct").alias("name"),
        F.when(user, asked).otherwise(told).alias("arguments"), F.when(user & after.isNotNull(), F.array(after)).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    answered = F.when(F.col("role") == "assistant", F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")))
    results = messages.where(~F.coalesce(F.col("role").isin("user", "system"), F.lit(False))).select(
        "conv_id", "turn", answered.alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op7_linked_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_calls(*conversation_calls(table(spark, sf_dir, "conversations")), CONVERSATION_TOOLS)
