"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results are joined on their identifier. A call may need the result of one earlier
call; its level is the number of calls below it, found by doubling pointers: every round
each call points twice as far, so the rounds follow the logarithm of the longest
chain and no conversation meets in one task. Arguments are parsed as JSON and held
against the tool's schema. Every call, and every result without one, becomes a row with canonical
JSON: keys in order, no blanks.

Defined results, as ``status``: ``ok``; ``orphan_result`` (no such call); ``invalid_json``;
``unknown_tool``; ``invalid_arguments`` with the errors listed; ``unknown_need`` (the needed call is
missing); ``cyclic`` (level null); ``no_result``; the first that applies, in the order orphan,
JSON, tool, arguments, need, cycle, result. Equal calls or results of one identifier count
once, and ``copies`` says how many rows an identifier has. Of its different ones the least (name, arguments, need)
and the least content are linked, and others need that call; each further result is a row of its own with the
least call, each further call one with the least result. Rows without an identifier are left out of linking and come back as
``no_identifier``. Null arguments are invalid JSON. Extra columns stay out of the way.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored

#: JSON schema types and the beginnings of the engine's names for them.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID",
         "number": "(BIGINT|DECIMAL|DOUBLE)"}


def levels(calls: DataFrame) -> DataFrame:
    """(id, level, root_need) of ``calls`` (id, need): level null in a cycle, root_need the missing id a chain ends at."""
    state = stored(calls.select("id", F.col("need").alias("up"), F.when(F.col("need").isNull(), 0).otherwise(1).cast("long").alias("level"),
                                F.lit(None).cast("string").alias("missing")), "levels")
    rows = state.count()
    reach = 1
    while reach <= rows and not state.where("up is not null").isEmpty():
        ends = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("level").alias("steps"),
                            F.col("missing").alias("lost"))
        open_ = state.where("up is not null").select("id", "up", "level").join(ends, "up", "left")
        found = F.col("steps").isNotNull()
        moved = open_.select("id", F.when(found, F.col("further")).alias("up"),
                             F.when(found, F.col("level") + F.col("steps")).otherwise(F.col("level") - 1).alias("level"),
                             F.when(found, F.col("lost")).otherwise(F.col("up")).alias("missing"))
        left = stored(state.where("up is null").unionByName(moved), "levels")
        dropped(state)
        state, reach = left, reach * 2
    return state.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), F.col("missing").alias("root_need"))


def argument_errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with parsed ``arguments`` (map of variants) under ``fields`` (array of field, type, required), sorted."""
    def kind(field):
        wanted = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))[field["type"]]
        return F.regexp_like(F.schema_of_variant(arguments[field["field"]]), F.concat(F.lit("^"), wanted))

    has = lambda field: F.map_contains_key(arguments, field["field"])
    missing = F.transform(F.filter(fields, lambda x: x["required"] & ~has(x)), lambda x: F.concat(F.lit("missing "), x["field"]))
    wrong = F.transform(F.filter(fields, lambda x: has(x) & ~F.coalesce(kind(x), F.lit(False))), lambda x: F.concat(F.lit("type "), x["field"]))
    names = F.transform(fields, lambda x: x["field"])
    extra = F.transform(F.array_except(F.map_keys(arguments), names), lambda x: F.concat(F.lit("unexpected "), x))
    return F.array_sort(F.concat(missing, wrong, extra))


def _judged(both: DataFrame, schemas: DataFrame) -> DataFrame:
    """(id, level, status, errors, copies, json) of calls with their result and level."""
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    both = both.join(fields.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").drop("_name")
    parsed = F.try_parse_json("arguments")
    both = (both.withColumn("parsed", parsed)
            .withColumn("object", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.from_json("arguments", "map<string,variant>")))
            .withColumn("errors", F.when(F.col("object").isNotNull() & F.col("fields").isNotNull(), argument_errors(F.col("object"), F.col("fields")))))
    status = (F.when(F.col("calls").isNull(), "orphan_result").when(F.col("object").isNull(), "invalid_json")
              .when(F.col("fields").isNull(), "unknown_tool").when(F.size("errors") > 0, "invalid_arguments")
              .when(F.col("root_need").isNotNull(), "unknown_need").when(F.col("level").isNull(), "cyclic")
              .when(F.col("results").isNull(), "no_result").otherwise("ok"))
    whole = F.to_json(F.struct(F.when(F.col("object").isNotNull(), F.col("parsed")).alias("arguments"), "id", "level", "name", F.col("content").alias("result")),
                      {"ignoreNullFields": "false"})
    return both.select("id", "level", status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
                       (F.coalesce("calls", F.lit(0)) + F.coalesce("results", F.lit(0))).alias("copies"), whole.alias("json"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(id, level, status, errors, copies, json) for every call and orphan result.

    ``calls``: id, name, arguments (JSON text), need (id of another call, or null);
    ``results``: id, content; ``schemas``: name, field, type, required.
    """
    told = calls.select(F.col("id").cast("string").alias("id"), "name", "arguments", F.col("need").cast("string").alias("need"))
    given = results.select(F.col("id").cast("string").alias("id"), "content")
    call = F.struct("name", "arguments", "need")
    told_once = stored(told.where("id is not null").groupBy("id", "name", "arguments", "need").agg(F.count("*").alias("calls")), "told")
    given_once = stored(given.where("id is not null").groupBy("id", "content").agg(F.count("*").alias("results")), "given")
    each = stored(told_once.groupBy("id").agg(F.min(call).alias("call"), F.sum("calls").alias("calls"))
                  .select("id", "call.name", "call.arguments", "call.need", "calls"), "calls")
    answers = given_once.groupBy("id").agg(F.min("content").alias("content"), F.sum("results").alias("results"))
    found = stored(levels(each), "found")
    least = each.select(F.col("id").alias("_id"), call.alias("_call"), F.col("calls").alias("_calls"))
    further = told_once.drop("calls").join(least, F.col("id") == F.col("_id")).where(~call.eqNullSafe(F.col("_call")))
    below = found.select(F.col("id").alias("_need"), F.col("level").alias("_level"), F.col("root_need").alias("_root"))
    further = further.join(below, F.col("need") == F.col("_need"), "left").select(
        "id", "name", "arguments", "need", F.col("_calls").alias("calls"),
        F.when(F.col("need").isNull() | F.col("_need").isNull(), 0).otherwise(F.col("_level") + 1).cast("long").alias("level"),
        F.when(F.col("_need").isNull(), F.col("need")).otherwise(F.col("_root")).alias("root_need")).join(answers, "id", "left")
    linked_answers = answers.select(F.col("id").alias("_id"), F.col("content").alias("_content"), F.col("results").alias("_results"))
    others = given_once.drop("results").join(linked_answers, F.col("id") == F.col("_id")).where(~F.col("content").eqNullSafe(F.col("_content")))
    others = others.select("id", "content", F.col("_results").alias("results")).join(each, "id", "left").join(found, "id", "left")
    rest = further.unionByName(others.select(further.columns))
    both = each.join(answers, "id", "full").join(found, "id", "left").select(further.columns)
    linked = _judged(rest, schemas).unionByName(_judged(both, schemas))
    nameless = told.where("id is null").select("id", "name", F.lit(None).cast("string").alias("content")).unionByName(
        given.where("id is null").select("id", F.lit(None).cast("string").alias("name"), "content"))
    nothing = F.struct(F.lit(None).cast("string").alias("arguments"), "id", F.lit(None).cast("long").alias("level"), "name", F.col("content").alias("result"))
    return linked.unionByName(nameless.select(
        "id", F.lit(None).cast("long").alias("level"), F.lit("no_identifier").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.lit(1).cast("long").alias("copies"), F.to_json(nothing, {"ignoreNullFields": "false"}).alias("json")))
