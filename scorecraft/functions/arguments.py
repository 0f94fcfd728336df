"""Tool-call arguments as typed leaf rows (O-65, O-66, O-67).

Arguments arrive as JSON text.  One Arrow pass reads each text once, with
Python's JSON rules (the last of repeated names wins, ``NaN`` is a number), and
gives its leaves ``(key, type_tag, str_val, num_val)``: dotted keys for nested
objects at any depth, lists whole as JSON text with sorted names, ``title``
dropped at every object level, empty objects nothing.  Text that is not JSON
gives one leaf with tag ``invalid`` and the empty key, so it stays visible.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.functions.output_parser import clean_text
from scorecraft.functions.partitioning import by_key

IGNORED_PARAMS = ("title",)
LEAVES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("type_tag", T.StringType()),
                                   T.StructField("str_val", T.StringType()), T.StructField("num_val", T.DoubleType())]))
_LEAF = pa.struct([("key", pa.string()), ("type_tag", pa.string()), ("str_val", pa.string()), ("num_val", pa.float64())])


def leaf(key: str, value) -> tuple:
    """Comparison class of a value: str, num, bool (compared as a number), null
    or list."""
    if value is None:
        return key, "null", None, None
    if isinstance(value, bool):
        return key, "bool", None, float(value)
    if isinstance(value, str):
        return key, "str", clean_text(value), None
    if isinstance(value, list):
        return key, "list", clean_text(json.dumps(value, sort_keys=True)), None
    try:
        return key, "num", None, float(value)
    except OverflowError:
        return key, "num", None, float("inf") if value > 0 else float("-inf")


def leaves_of(text: str) -> list[tuple]:
    """All leaves of one argument text, in the order of the text."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [("", "invalid", text, None)]
    out, todo = [], [("", value)] if isinstance(value, dict) else []
    while todo:
        prefix, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{prefix}.{k}" if prefix else k, v) for k, v in reversed(value.items()) if k not in IGNORED_PARAMS]
        else:
            out.append(leaf(clean_text(prefix), value))
    return out


@F.arrow_udf(LEAVES)
def argument_leaves(texts: pa.Array) -> pa.Array:
    rows, ends = [], [0]
    for text in texts.to_pylist():
        if text is not None:
            rows += leaves_of(text)
        ends.append(len(rows))
    columns = list(zip(*rows)) or [()] * 4
    leaves = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEAF)], fields=list(_LEAF))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaves)


@F.arrow_udf(T.BooleanType())
def is_json(texts: pa.Array) -> pa.Array:
    """Whether each element of a JSON array of texts is readable JSON."""
    def readable(t: str) -> bool:
        try:
            json.loads(t)
            return True
        except (ValueError, RecursionError):
            return False

    return pa.array([None if t is None else all(map(readable, json.loads(t))) for t in texts.to_pylist()], pa.bool_())


def flatten_arguments(calls: DataFrame, keep: list[str], args_col: str = "arguments",
                      partition_by: str | None = None, call_rows: bool = False, gather: str | None = None) -> DataFrame:
    """One row per leaf argument of each call.

    ``keep`` columns are carried through.  Output adds ``key, base_key,
    type_tag, str_val, num_val``.  With ``partition_by`` the calls are
    hash-partitioned on that key first, as the consumers aggregate by it.  With
    ``call_rows`` every call also yields one marker row with NULL ``key``, so
    calls without arguments stay visible downstream.  A Python stage gives up the
    partitioning: with ``gather`` the calls, leaves still nested, are
    hash-partitioned on that key after it, so that no consumer shuffles leaf rows.
    """
    if partition_by is not None:
        calls = by_key(calls, partition_by)
    # The leaves become a column of their own, so that the UDF runs once per call.
    found = calls.select(*keep, argument_leaves(F.col(args_col)).alias("_leaves"))
    if gather is not None:
        found = by_key(found, gather)
    leaves = F.coalesce(F.col("_leaves"), F.array().cast(LEAVES))
    if call_rows:
        marker = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("type_tag"),
                                  F.lit(None).cast("string").alias("str_val"), F.lit(None).cast("double").alias("num_val")))
        leaves = F.concat(marker, leaves)
    return found.select(*keep, F.inline(leaves)).select(
        *keep, "key", F.substring_index(F.col("key"), ".", 1).alias("base_key"), "type_tag", "str_val", "num_val")


def values_match(g_tag: Column, g_str: Column, g_num: Column,
                 p_tag: Column, p_str: Column, p_num: Column) -> Column:
    """O-67: NULL only equals NULL; text (and list text) compares
    case-insensitively; numbers (bool included) within 1e-9; other mixes
    are unequal."""
    text = ["str", "list", "invalid"]
    number = ["num", "bool"]
    return (F.when((g_tag == "null") | (p_tag == "null"), (g_tag == "null") & (p_tag == "null"))
            .when(g_tag.isin(*text) & p_tag.isin(*text), F.lower(g_str) == F.lower(p_str))
            .when(g_tag.isin(*number) & p_tag.isin(*number), F.abs(g_num - p_num) < F.lit(1e-9))
            .otherwise(F.lit(False)))


FILTER_MEMBERS = ("categories", "payees")


def simplified(node):
    """A call value in the simplified schema's layout (see ``simplify_calls``)."""
    if isinstance(node, list):
        return [simplified(v) for v in node]
    if not isinstance(node, dict):
        return node
    out: dict = {}
    for name, value in node.items():
        if isinstance(value, dict) and name == "filter":
            out |= {f"filter_{m}": value[m] for m in FILTER_MEMBERS if m in value}
        elif isinstance(value, dict) and name == "data_source":
            out |= simplified(value)
        elif isinstance(value, str) and name == "arguments":
            inner = json.loads(value)
            out[name] = json.dumps(simplified(inner)) if isinstance(inner, dict) else value
        else:
            out[name] = simplified(value)
    return out


@F.arrow_udf(T.StringType())
def simplify_calls(texts: pa.Array) -> pa.Array:
    """O-13 on the ``tool_calls`` text of messages: at every level, lists
    included, ``data_source`` members move up and ``filter`` becomes
    ``filter_categories`` / ``filter_payees``.  Unreadable text stays as it is."""
    def rewritten(text):
        try:
            return clean_text(json.dumps(simplified(json.loads(text)), ensure_ascii=False, separators=(",", ":")))
        except (ValueError, RecursionError):
            return text

    return pa.array([None if t is None else rewritten(t) for t in texts.to_pylist()], pa.string())


def simplify_filter_keys(flat: DataFrame) -> DataFrame:
    """O-13 on flattened arguments (for the simplified tool schema):
    ``data_source`` members move up one level; ``filter.categories`` and
    ``filter.payees`` become ``filter_categories`` / ``filter_payees`` (also
    when the filter sits inside ``data_source``); other ``filter`` members are
    dropped."""
    k = F.regexp_replace(F.col("key"), r"(^|\.)data_source\.", "$1")
    k = F.regexp_replace(k, r"(^|\.)filter\.(categories|payees)($|\.)", "$1filter_$2$3")
    return (flat.withColumn("key", k)
            .filter(~F.col("key").rlike(r"(^|\.)filter\."))
            .withColumn("base_key", F.substring_index(F.col("key"), ".", 1)))
