"""Chat datasets (O-01, O-08) -> the ``turns`` table.

``turns(category, conv_id, uid, turn_idx, role, content, tool_calls)``, with
``turn_idx`` the message position (``posexplode``) and ``tool_calls`` the raw
JSON text of the message's call(s).  Both the plural ``tool_calls`` and the
singular ``tool_call`` spellings are accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("complete", "incomplete", "nlp")

# A STRING field keeps a nested JSON value as its raw text (no inference).
MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.StringType()),
    T.StructField("tool_call", T.StringType()),
])
SAMPLE = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("messages", T.ArrayType(MESSAGE)),
])

LEGACY_TOOL = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("tool", T.StringType()),
    T.StructField("arguments", T.StringType()), T.StructField("parameters", T.StringType())])
LEGACY_TURN = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("tools", T.ArrayType(LEGACY_TOOL))]))])
LEGACY_CONVERSATION = T.ArrayType(LEGACY_TURN)


def _explode_messages(samples: DataFrame) -> DataFrame:
    """samples(category, sample_idx, uid, messages) -> turns."""
    m = samples.select("category", F.col("sample_idx").alias("conv_id"), F.coalesce("uid", F.lit("")).alias("uid"),
                       F.posexplode("messages").alias("turn_idx", "m"))
    return m.select("category", "conv_id", "uid", F.col("turn_idx").cast("bigint").alias("turn_idx"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content"),
                    F.coalesce("m.tool_calls", "m.tool_call").alias("tool_calls"))


def load_dataset(spark: SparkSession, path: str, categories=CATEGORIES, max_samples: int = 0) -> DataFrame:
    """O-01/O-11/O-12: a JSON object ``{category: [sample, ...]}`` (one
    document per file).  Categories keep their fixed order; a category whose
    value is not a list reads as empty; ``max_samples > 0`` keeps the first n
    per category in file order."""
    schema = T.StructType([T.StructField(c, T.ArrayType(SAMPLE)) for c in categories])
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    stacked = doc.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("samples")) for c in categories])).alias("c"))
    samples = stacked.select("c.category", F.posexplode_outer("c.samples").alias("sample_idx", "s")).filter(
        F.col("s").isNotNull())
    if max_samples and max_samples > 0:
        samples = samples.filter(F.col("sample_idx") < max_samples)
    return _explode_messages(samples.select("category", "sample_idx", "s.uid", "s.messages"))


def load_dataset_lines(spark: SparkSession, path: str, categories=CATEGORIES) -> DataFrame:
    """Splittable variant: JSON Lines, one sample per line with ``category``
    and ``sample_idx`` fields."""
    schema = T.StructType([T.StructField("category", T.StringType()),
                           T.StructField("sample_idx", T.LongType()), *SAMPLE.fields])
    df = spark.read.schema(schema).json(path).filter(F.col("category").isin(list(categories)))
    return _explode_messages(df)


def normalise_legacy(conversations: DataFrame, doc_col: str = "doc", key_col: str = "conv_id") -> DataFrame:
    """O-08: legacy conversations (a list of ``{query, ground_truth}`` turns)
    -> turns.  Each turn becomes a user message and an assistant message
    whose calls use ``name``/``arguments`` (``tool``/``parameters`` are
    accepted as aliases).  ``doc_col`` holds the conversation (JSON text or
    parsed)."""
    doc = F.col(doc_col)
    if dict(conversations.dtypes)[doc_col] == "string":
        doc = F.from_json(doc, LEGACY_CONVERSATION)
    t = conversations.select(F.col(key_col).alias("conv_id"), F.posexplode(doc).alias("pos", "t"))
    gt = F.col("t.ground_truth")
    calls = F.transform(gt["tools"], lambda c: F.struct(
        F.coalesce(c["name"], c["tool"], F.lit("")).alias("name"),
        F.coalesce(c["parameters"], c["arguments"], F.lit("{}")).alias("arguments")))
    is_tool = (gt["type"] == "tool") & (F.coalesce(F.size(gt["tools"]), F.lit(0)) > 0)
    msgs = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("t.query").alias("content"),
                 F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("calls")),
        F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"),
                 F.when(~is_tool, gt["response"]).alias("content"), F.when(is_tool, calls).alias("calls")))
    out = t.select("conv_id", "pos", F.inline(msgs))
    return out.select("conv_id", (F.col("pos") * 2 + F.col("k")).cast("bigint").alias("turn_idx"), "role", "content",
                      F.when(F.col("calls").isNotNull(), F.to_json("calls")).alias("tool_calls"))
