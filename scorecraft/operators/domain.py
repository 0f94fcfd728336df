"""O-97: predicted argument values outside their closed vocabulary.

The vocabulary is a catalogue-sized dimension with one row per (tool, param):
``rules`` is an array of (conditions, allowed values), where the conditions map
names of the call's own text arguments to the value they must have (none: the
rule always applies).  Text leaves and the text elements of list leaves are
checked in place: a value is governed when some rule applies to its call, and
a violation when none of those allows it.  Nothing fans out by rule or value.

Calls are hash-partitioned on ``record_id`` before flattening, so the call
context (a window per call) reuses that partitioning; only the per-(tool,
param) counts shuffle, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.functions.arguments import flatten_arguments
from scorecraft.functions.partitioning import bounded_broadcast


def argument_values(calls: DataFrame) -> DataFrame:
    """One row per checked value: ``record_id, ordinal, key, pos`` (its
    identity), ``tool``, ``param`` (last key segment), ``value`` and ``context``
    (the call's text arguments by param; the last in key order of repeated ones)."""
    flat = flatten_arguments(calls, ["record_id", "ordinal", "name"], partition_by="record_id")
    param = F.element_at(F.split("key", "\\."), -1)
    leaves = (flat.filter(F.col("type_tag").isin("str", "list"))
              .select("record_id", "ordinal", "key", F.col("name").alias("tool"), param.alias("param"),
                      "type_tag", "str_val"))
    call = Window.partitionBy("record_id", "ordinal")
    texts = F.collect_list(F.when(F.col("type_tag") == "str", F.struct("key", "param", "str_val"))).over(call)
    context = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(texts, lambda t: t["param"])),
        lambda name: F.struct(name.alias("key"), F.array_max(F.filter(texts, lambda t: t["param"] == name))["str_val"].alias("value"))))
    elems = F.when(F.col("type_tag") == "list", F.from_json("str_val", "array<string>")).otherwise(F.array("str_val"))
    return (leaves.withColumn("context", context).withColumn("elems", elems)
            .select("record_id", "ordinal", "key", "tool", "param", "context", F.posexplode("elems").alias("pos", "value")))


def check_values(values: DataFrame, param_enum: DataFrame) -> DataFrame:
    """Governed values with ``ok`` = allowed by an applicable rule.  The vocabulary is what is
    broadcast, by a hint: Spark does not know its size and would else send the values of a
    compressed table through the driver."""
    applies = F.filter("rules", lambda r: F.forall(
        F.map_entries(r["conditions"]), lambda c: F.coalesce(F.col("context")[c["key"]] == c["value"], F.lit(False))))
    return (values.join(bounded_broadcast(param_enum), ["tool", "param"]).withColumn("rules", applies).filter(F.size("rules") > 0)
            .withColumn("ok", F.exists("rules", lambda r: F.coalesce(F.array_contains(r["allowed"], F.col("value")), F.lit(False))))
            .drop("rules", "context"))


def arg_domain_violations(calls: DataFrame, param_enum: DataFrame) -> DataFrame:
    """Counts per (tool, param): governed values and violations."""
    checked = check_values(argument_values(calls), param_enum)
    return (checked.groupBy("tool", "param")
            .agg(F.count(F.lit(1)).alias("n_values"), F.count_if(~F.col("ok")).alias("n_violations")))
