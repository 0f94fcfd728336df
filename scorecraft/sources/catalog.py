"""Tool catalogue (O-03, O-04, O-05): JSON-Schema tool lists -> two small
dimension tables.

``tools(name, description)`` and ``tool_params(tool, param, type, enum,
required)``.  Accepts a bare list or ``{"tools": [...]}``; each entry may wrap
its schema in ``function``; parameters come from ``parameters.properties`` or a
top-level ``properties`` (both layouts exist in practice); ``required``
defaults to every property; a ``$ref`` property is resolved against ``$defs``
by its last path segment, recursively.  Both tables are bounded by the catalogue size, not
by the data, which is what makes broadcasting them safe.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DESCRIPTION = ""

@F.pandas_udf(T.StringType())
def _yaml_to_json(text: pd.Series) -> pd.Series:
    import json

    import yaml
    return text.map(lambda t: None if t is None else json.dumps(yaml.safe_load(t)))


def resolved(node, defs: dict, inside: tuple = ()):
    """A schema value with every ``$ref`` replaced by its definition (by the last
    path segment), at any depth; unknown and circular references stay."""
    if isinstance(node, list):
        return [resolved(v, defs, inside) for v in node]
    if not isinstance(node, dict):
        return node
    name = str(node.get("$ref", "")).rpartition("/")[2]
    if name in defs and name not in inside:
        return resolved(defs[name], defs, (*inside, name))
    return {k: resolved(v, defs, inside) for k, v in node.items()}


@F.pandas_udf(T.StringType())
def _resolve_json(text: pd.Series) -> pd.Series:
    """Catalogue text with the references of each tool resolved."""
    import json

    def one(t):
        doc = json.loads(t)
        tools = doc.get("tools", []) if isinstance(doc, dict) else doc
        for tool in tools:
            schema = tool.get("function", tool)
            params = schema.get("parameters", {})
            defs = {**(schema.get("$defs") or {}), **(params.get("$defs") or {})}
            for holder in (schema, params):
                if "properties" in holder:
                    holder["properties"] = resolved(holder["properties"], defs)
        return json.dumps(doc)

    return text.map(lambda t: None if t is None else one(t))


def catalog_documents(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """One row per catalogue document (``doc`` VARIANT).  A file is read whole
    (a catalogue is configuration-sized); inline text wins over a path; a
    ``.yaml``/``.yml`` file is converted to JSON on the executor."""
    if text is not None:
        df = spark.createDataFrame([(text,)], "value string")
    elif path is not None:
        df = spark.read.text(path, wholetext=True)
        if path.lower().endswith((".yaml", ".yml")):
            df = df.select(_yaml_to_json("value").alias("value"))
    else:
        raise ValueError("a catalogue path or inline text is required")
    return df.select(F.parse_json(_resolve_json("value")).alias("doc"))


def _entries(docs: DataFrame) -> DataFrame:
    arr = F.coalesce(F.try_variant_get("doc", "$.tools", "array<variant>"),
                     F.try_variant_get("doc", "$", "array<variant>"))
    e = docs.select(F.explode(arr).alias("t"))
    fn = F.coalesce(F.try_variant_get("t", "$.function", "variant"), F.col("t"))
    return e.select(fn.alias("fn"))


def tools_dim(docs: DataFrame) -> DataFrame:
    e = _entries(docs)
    return e.select(F.variant_get("fn", "$.name", "string").alias("name"),
                    F.coalesce(F.try_variant_get("fn", "$.description", "string"),
                               F.lit(DEFAULT_DESCRIPTION)).alias("description"))


def tool_params_dim(docs: DataFrame) -> DataFrame:
    e = _entries(docs)
    props = F.coalesce(F.try_variant_get("fn", "$.parameters.properties", "map<string,variant>"),
                       F.try_variant_get("fn", "$.properties", "map<string,variant>"))
    required = F.coalesce(F.try_variant_get("fn", "$.parameters.required", "array<string>"),
                          F.try_variant_get("fn", "$.required", "array<string>"))
    p = e.select(F.variant_get("fn", "$.name", "string").alias("tool"), F.explode(props).alias("param", "spec"),
                 required.alias("req"))
    # A property may give its type and values in the options of ``anyOf``.
    options = F.concat(F.array(F.col("spec")), F.coalesce(F.try_variant_get("spec", "$.anyOf", "array<variant>"),
                                                          F.array().cast("array<variant>")))

    def first(path: str, kind: str):
        found = F.transform(options, lambda o: F.try_variant_get(o, path, kind))
        return F.get(F.filter(found, lambda v: v.isNotNull() & (v != F.lit("null")) if kind == "string" else v.isNotNull()), F.lit(0))

    return p.select(
        "tool", "param", first("$.type", "string").alias("type"), first("$.enum", "array<string>").alias("enum"),
        F.when(F.col("req").isNull(), F.lit(True))
         .otherwise(F.array_contains(F.col("req"), F.col("param"))).alias("required"),
    )


def vllm_tools(docs: DataFrame) -> DataFrame:
    """O-25: the catalogue as one JSON array of ``{type: function, function:
    {name, description, parameters: {type, properties, required}}}`` (one row);
    ``required`` defaults to every property."""
    e = _entries(docs)
    props = F.coalesce(F.try_variant_get("fn", "$.parameters.properties", "variant"), F.try_variant_get("fn", "$.properties", "variant"))
    names = F.map_keys(F.try_variant_get(props, "$", "map<string,variant>"))
    required = F.coalesce(F.try_variant_get("fn", "$.parameters.required", "array<string>"),
                          F.try_variant_get("fn", "$.required", "array<string>"), names)
    item = F.struct(
        F.lit("function").alias("type"),
        F.struct(F.variant_get("fn", "$.name", "string").alias("name"),
                 F.coalesce(F.try_variant_get("fn", "$.description", "string"), F.lit(DEFAULT_DESCRIPTION)).alias("description"),
                 F.struct(F.lit("object").alias("type"), props.alias("properties"), required.alias("required")).alias("parameters"),
                 ).alias("function"))
    return e.agg(F.to_json(F.collect_list(item)).alias("tools_json"))


def param_enum_dim(docs: DataFrame) -> DataFrame:
    """O-97 dimension ``param_enum(tool, param, rules)`` from a catalogue: each
    property's ``enum`` (no conditions) and each ``allOf`` if/then rule's
    array-item or scalar enum under the constants of its ``if``.  A rule is
    (conditions map, allowed array); options of one rule (``anyOf``) are merged."""
    e = _entries(docs).select(F.variant_get("fn", "$.name", "string").alias("tool"), "fn")
    props = F.coalesce(F.try_variant_get("fn", "$.parameters.properties", "map<string,variant>"),
                       F.try_variant_get("fn", "$.properties", "map<string,variant>"))
    none = F.create_map().cast("map<string,string>")
    plain = (e.select("tool", F.explode(props).alias("param", "spec"))
             .select("tool", "param", none.alias("conditions"), F.try_variant_get("spec", "$.enum", "array<string>").alias("allowed")))
    rules = e.select("tool", F.explode(F.try_variant_get("fn", "$.parameters.allOf", "array<variant>")).alias("rule"))
    constants = F.transform_values(F.try_variant_get("rule", "$.if.properties", "map<string,variant>"),
                                   lambda _, v: F.try_variant_get(v, "$.const", "string"))
    then = rules.select("tool", F.map_filter(constants, lambda _, v: v.isNotNull()).alias("conditions"),
                        F.explode(F.try_variant_get("rule", "$.then.properties", "map<string,variant>")).alias("param", "spec"))
    options = F.coalesce(F.try_variant_get("spec", "$.anyOf", "array<variant>"), F.array(F.col("spec")))
    values = F.flatten(F.transform(options, lambda o: F.coalesce(
        F.try_variant_get(o, "$.items.enum", "array<string>"), F.try_variant_get(o, "$.enum", "array<string>"),
        F.array().cast("array<string>"))))
    cond = then.select("tool", "param", F.coalesce("conditions", none).alias("conditions"), values.alias("allowed"))
    return (plain.unionByName(cond).filter(F.size("allowed") > 0)
            .groupBy("tool", "param").agg(F.collect_list(F.struct("conditions", "allowed")).alias("rules")))
