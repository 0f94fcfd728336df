"""Pre-processing: chat turns -> prediction records.

Input ``turns``: one row per message with columns
``category, conv_id, uid, turn_idx, role, content, tool_calls`` where
``turn_idx`` is the 0-based position within the sample (as produced by
``posexplode``) and ``tool_calls`` is the raw JSON text of the call(s) or NULL.

A sample is identified by ``(category, conv_id)``.  Every join below keys on
the sample *and* the turn position, a unique composite key, so a conversation
holding a large share of all turns is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.windows import first_n_per_group, running_max_blocked

SAMPLE = ["category", "conv_id"]
CATEGORIES = ("complete", "incomplete", "nlp")


def record_id(category, conv_id, turn) -> F.Column:
    """Stable record key: category, sample and trigger turn."""
    return F.concat_ws(":", category, conv_id.cast("string"), turn.cast("string"))


def filter_categories(turns: DataFrame, categories=CATEGORIES) -> DataFrame:
    """O-11: keep the wanted categories (default: all three)."""
    return turns.filter(F.col("category").isin(list(categories)))


def head_per_category(turns: DataFrame, n: int) -> DataFrame:
    """O-12: first ``n`` samples per category in sample order; n <= 0 keeps all."""
    if n is None or n <= 0:
        return turns
    samples = turns.select(*SAMPLE).distinct()
    quotas = samples.groupBy("category").agg(F.lit(n).cast("long").alias("quota"))
    first = first_n_per_group(samples, ["category"], F.col("conv_id"), quotas, n).select(*SAMPLE)
    return turns.join(first, SAMPLE, "left_semi")


def sample_sizes(turns: DataFrame) -> DataFrame:
    """Messages per sample (partial aggregation before the shuffle)."""
    return turns.groupBy(*SAMPLE).agg(F.count(F.lit(1)).alias("n_messages"))


def split_short_samples(turns: DataFrame, min_messages: int = 2):
    """O-16: (kept turns, quarantined samples with fewer than ``min_messages``)."""
    sizes = sample_sizes(turns)
    short = sizes.filter(F.col("n_messages") < min_messages)
    kept = turns.join(short.select(*SAMPLE), SAMPLE, "left_anti")
    return kept, short


def rewrite_turns(turns: DataFrame, template_has_tool_token: bool = False) -> DataFrame:
    """O-14: for models without tool tokens, an assistant call becomes
    ``<tool_call>json</tool_call>`` content and a tool turn becomes a user turn
    ``<tool_response>..</tool_response>``; otherwise unchanged."""
    if template_has_tool_token:
        return turns
    is_call = (F.col("role") == "assistant") & F.col("tool_calls").isNotNull()
    is_tool = F.col("role") == "tool"
    return (turns
            .withColumn("content", F.when(is_call, F.concat(F.lit("<tool_call>"), F.col("tool_calls"), F.lit("</tool_call>")))
                        .when(is_tool, F.concat(F.lit("<tool_response>"), F.coalesce(F.col("content"), F.lit("")), F.lit("</tool_response>")))
                        .otherwise(F.col("content")))
            .withColumn("role", F.when(is_tool, F.lit("user")).otherwise(F.col("role"))))


def _with_successor(turns: DataFrame) -> DataFrame:
    nxt = turns.select(*SAMPLE, (F.col("turn_idx") - 1).alias("turn_idx"),
                       F.col("role").alias("next_role"), F.col("content").alias("next_content"),
                       F.col("tool_calls").alias("next_tool_calls"))
    return turns.join(nxt, [*SAMPLE, "turn_idx"], "left")


def prediction_records(turns: DataFrame, min_messages: int = 2) -> DataFrame:
    """O-15/O-16/O-17: one record per user turn with a successor (ground truth
    = the successor) and per tool turn (ground truth = itself).

    The context is not materialised here: it is the sample's turns
    ``0..trigger_turn`` (see :func:`materialise_context`).  Scoring needs only
    the ground truth and the last user turn, so the quadratic context stays
    out of the scoring plan.
    """
    kept, _ = split_short_samples(turns, min_messages)
    t = _with_successor(kept)
    is_user = (F.col("role") == "user") & F.col("next_role").isNotNull()
    is_tool = F.col("role") == "tool"
    recs = t.filter(is_user | is_tool)
    gt_role = F.when(is_user, F.col("next_role")).otherwise(F.col("role"))
    gt_calls = F.when(is_user, F.col("next_tool_calls")).otherwise(F.col("tool_calls"))
    return recs.select(
        record_id(F.col("category"), F.col("conv_id"), F.col("turn_idx")).alias("record_id"),
        *SAMPLE, "uid",
        F.col("role").alias("trigger_role"),
        F.col("turn_idx").alias("trigger_turn"),
        F.when(is_user, F.col("turn_idx") + 1).otherwise(F.col("turn_idx")).alias("gt_turn_index"),
        gt_role.alias("gt_role"),
        F.when(is_user, F.col("next_content")).otherwise(F.col("content")).alias("gt_content"),
        gt_calls.alias("gt_tool_calls"),
        F.when(gt_calls.isNotNull(), F.lit("tool")).otherwise(F.lit("nlp")).alias("gt_type"),
        (F.col("turn_idx") + 1).alias("n_context"),
    )


def dangling_user_turns(turns: DataFrame, min_messages: int = 2) -> DataFrame:
    """O-17 quarantine: user turns with no following message."""
    kept, _ = split_short_samples(turns, min_messages)
    t = _with_successor(kept)
    return (t.filter((F.col("role") == "user") & F.col("next_role").isNull())
            .select(*SAMPLE, "uid", "turn_idx"))


def text_ground_truth(records: DataFrame) -> DataFrame:
    """O-50: records whose ground-truth message carries text (tool turns
    included) -- the content benchmark's population."""
    return records.filter(F.col("gt_content").isNotNull())


BLOCK = 16_384                # turns of a sample that are gathered together


def materialise_context(records: DataFrame, turns: DataFrame, system_text: str | None = None,
                        template_has_tool_token: bool = False, block: int = BLOCK) -> DataFrame:
    """O-15 context + O-18 system turn: ``ARRAY<STRUCT<role, content>>`` per record.

    A sample's turns are gathered once per (sample, block of ``block`` turns), and its
    records likewise; the two meet on that key, and each record cuts the block's array at
    its turn, so a turn's text is moved once however many records read it.  Only samples
    longer than a block need more: their later blocks are given the earlier ones whole, once
    per block and not per record."""
    rw = rewrite_turns(turns, template_has_tool_token).select(*SAMPLE, "turn_idx", "role", "content")
    at = [*SAMPLE, "block"]
    blocks = (rw.withColumn("block", F.floor(F.col("turn_idx") / block)).groupBy(*at)
              .agg(F.sort_array(F.collect_list(F.struct("turn_idx", "role", "content"))).alias("turns")))
    readers = (records.select("record_id", *SAMPLE, "trigger_turn", F.floor(F.col("trigger_turn") / block).alias("block"))
               .groupBy(*at).agg(F.collect_list(F.struct("record_id", "trigger_turn")).alias("readers")))
    late = readers.filter("block > 0").select(*SAMPLE, F.col("block").alias("late"))
    whole = blocks.withColumnRenamed("block", "early")
    before = (late.join(whole, SAMPLE).filter("early < late").groupBy(*SAMPLE, F.col("late").alias("block"))
              .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("early", "turns"))), lambda b: b["turns"])).alias("before")))
    met = readers.join(blocks, at).join(before, at, "left")
    each = met.select("turns", "before", F.explode("readers").alias("r")).select(
        "r.record_id", F.coalesce("before", F.array().cast(blocks.schema["turns"].dataType)).alias("before"),
        F.filter("turns", lambda t: t["turn_idx"] <= F.col("r.trigger_turn")).alias("own"))
    context = F.transform(F.concat("before", "own"), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    if system_text is not None:
        context = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content"))), context)
    return each.select("record_id", context.alias("context"))


def system_message(sections: list[str]) -> str:
    """O-18: system text = prompt sections joined by a blank line."""
    return "\n\n".join(sections)


def last_user_query(records: DataFrame, turns: DataFrame, template_has_tool_token: bool = False) -> DataFrame:
    """O-21: content of the last ``user`` message in each record's context
    ('' if none).  Roles are those after O-14, so a rewritten tool turn counts.

    The "last user position so far" is a running max computed block-wise
    (skew-safe); the content is then fetched by an equi-join on
    (sample, position)."""
    rw = rewrite_turns(turns, template_has_tool_token).select(*SAMPLE, "turn_idx", "role", "content")
    pos = running_max_blocked(rw, SAMPLE, "turn_idx",
                              F.when(F.col("role") == "user", F.col("turn_idx")), "last_user_idx")
    at = pos.select(*SAMPLE, F.col("turn_idx").alias("trigger_turn"), "last_user_idx")
    q = records.select("record_id", *SAMPLE, "trigger_turn").join(at, [*SAMPLE, "trigger_turn"], "left")
    user_text = rw.select(*SAMPLE, F.col("turn_idx").alias("last_user_idx"), F.col("content").alias("query"))
    return (q.join(user_text, [*SAMPLE, "last_user_idx"], "left")
            .select("record_id", F.coalesce(F.col("query"), F.lit("")).alias("query")))
