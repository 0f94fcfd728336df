"""Tool-call scoring (O-47..O-68).

Inputs
  items  (record_id, gt_type, pred_type[, raw_text, raw_ok]) -- one row per record
  calls  (record_id, side 'gt'|'pred', ordinal, name, arguments JSON text)
  tools  (name)            -- catalogue dimension (bounded by the catalogue)
  params (tool, param)     -- catalogue dimension

Every intermediate is keyed by ``record_id`` first.  ``prepare_calls``
hash-partitions the calls on ``record_id`` once and adds the call-level
attributes every metric needs (stable rank by name, last call per name); the
windows and the aggregations on (record_id, ...) then reuse that
partitioning.  ``tool_scores_wide`` flattens the arguments once and shares the
leaf table between the variable and exact-match metrics.  A record holds the
calls of one model answer (bounded by the answer length), so no key is hot;
the two catalogue tables are the only broadcasts, their size checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.functions.arguments import IGNORED_PARAMS, flatten_arguments, values_match
from scorecraft.functions.partitioning import bounded_broadcast, by_key
from scorecraft.functions.text import py_strip

CALL_KEEP = ["record_id", "side", "ordinal", "name", "rank", "is_last"]

METRICS = ["when2call", "schema_reliability_raw", "schema_reliability_processed",
           "tool_pick_up_rate", "tool_hallucination_rate", "tool_additional_rate",
           "variable_pickup_rate", "variable_correct_rate", "variable_hallucination_rate",
           "variable_additional_rate", "exact_match"]


def _both_tool(items: DataFrame) -> DataFrame:
    return items.filter((F.col("gt_type") == "tool") & (F.col("pred_type") == "tool")).select("record_id")


def _div(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def prepare_calls(calls: DataFrame) -> DataFrame:
    """Calls hash-partitioned on ``record_id`` with ``rank`` (1-based, stable
    sort by name then ordinal, per side) and ``is_last`` (last call of its
    name on its side: dict semantics).  Idempotent."""
    if "rank" in calls.columns:
        return calls
    c = by_key(calls.withColumn("name", F.coalesce("name", F.lit(""))), "record_id")
    w_rank = Window.partitionBy("record_id", "side").orderBy("name", "ordinal")
    w_name = Window.partitionBy("record_id", "side", "name")
    return (c.withColumn("rank", F.row_number().over(w_rank))
            .withColumn("is_last", F.col("ordinal") == F.max("ordinal").over(w_name)))


def call_leaves(prepared: DataFrame) -> DataFrame:
    """Flattened arguments of every call, with the call attributes."""
    return flatten_arguments(prepared, CALL_KEEP)


def when2call(items: DataFrame) -> DataFrame:
    """O-58: 1.0 when the predicted type equals the ground-truth type."""
    same = F.coalesce(F.col("gt_type"), F.lit("error")) == F.coalesce(F.col("pred_type"), F.lit("error"))
    return items.select("record_id", F.when(same, 1.0).otherwise(0.0).alias("score_when2call"))


def schema_reliability(items: DataFrame) -> DataFrame:
    """O-59/O-60: NULL unless the ground truth is a tool call.  Raw: NULL
    without raw text, 1.0 for blank text or text that is strict JSON or a
    pythonic call (``raw_ok``, decided in the parse stage), else 0.0.
    Processed: 1.0 iff the parsed prediction is a tool call."""
    return items.select("record_id", *_item_score_columns(items.columns)[1:])


def tool_pickup(items: DataFrame, calls: DataFrame, tools: DataFrame) -> DataFrame:
    """O-62: with distinct name sets G (truth), P (prediction), A (catalogue)
    and n = number of ground-truth calls (duplicates included):
    |G∩P|/n, |P−A|/n, |(P∩A)−G|/n.  NULL unless both sides are tool calls."""
    names = (prepare_calls(calls)
             .groupBy("record_id", "name")
             .agg(F.count_if(F.col("side") == "gt").alias("n_g"),
                  F.count_if(F.col("side") == "pred").alias("n_p")))
    cat = bounded_broadcast(tools.select("name", F.lit(True).alias("in_a")).distinct())
    names = names.join(cat, "name", "left")
    in_g, in_p, in_a = F.col("n_g") > 0, F.col("n_p") > 0, F.col("in_a").isNotNull()
    per = names.groupBy("record_id").agg(
        F.sum("n_g").alias("n"),
        F.count_if(in_g & in_p).alias("c"),
        F.count_if(in_p & ~in_a).alias("h"),
        F.count_if(in_p & in_a & ~in_g).alias("a"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return (_both_tool(items).join(per, "record_id", "left")
            .select("record_id",
                    _div(F.coalesce("c", F.lit(0)), n).alias("score_tool_pick_up_rate"),
                    _div(F.coalesce("h", F.lit(0)), n).alias("score_tool_hallucination_rate"),
                    _div(F.coalesce("a", F.lit(0)), n).alias("score_tool_additional_rate")))


def variable_metrics(items: DataFrame, calls: DataFrame, params: DataFrame,
                     leaves: DataFrame | None = None) -> DataFrame:
    """O-63 (with O-55..57, O-65..67): for every ground-truth tool that is
    also predicted, classify each predicted flat key: base key outside the
    tool's schema -> hallucinated; in the truth -> picked up (and correct
    when the values match); otherwise additional.  Each count is divided by
    the number of truth keys, summed over tools and divided by the number of
    truth calls.  A predicted tool whose truth has no keys makes the record
    NULL (the reference divides by zero there)."""
    prepared = prepare_calls(calls)
    last = prepared.filter("is_last")
    flat = (leaves if leaves is not None else call_leaves(prepared)).filter("is_last")
    g = flat.filter(F.col("side") == "gt").select(
        "record_id", "name", "key", F.col("type_tag").alias("g_tag"),
        F.col("str_val").alias("g_str"), F.col("num_val").alias("g_num"))
    p = flat.filter(F.col("side") == "pred").select(
        "record_id", "name", "key", "base_key", F.col("type_tag").alias("p_tag"),
        F.col("str_val").alias("p_str"), F.col("num_val").alias("p_num"))
    g_names = last.filter(F.col("side") == "gt").select("record_id", "name")
    p_names = last.filter(F.col("side") == "pred").select("record_id", "name")
    both = g_names.join(p_names, ["record_id", "name"])
    valid = bounded_broadcast(params.filter(~F.col("param").isin(*IGNORED_PARAMS))
                        .select(F.col("tool").alias("name"), F.col("param").alias("base_key"),
                                F.lit(True).alias("valid")).distinct())
    pk = (p.join(both, ["record_id", "name"], "left_semi")
          .join(valid, ["name", "base_key"], "left")
          .join(g, ["record_id", "name", "key"], "left"))
    is_valid, in_gt = F.col("valid").isNotNull(), F.col("g_tag").isNotNull()
    match = values_match(F.col("g_tag"), F.col("g_str"), F.col("g_num"),
                         F.col("p_tag"), F.col("p_str"), F.col("p_num"))
    per_tool = pk.groupBy("record_id", "name").agg(
        F.count_if(~is_valid).alias("h"),
        F.count_if(is_valid & in_gt).alias("k"),
        F.count_if(is_valid & in_gt & match).alias("c"),
        F.count_if(is_valid & ~in_gt).alias("a"))
    n_keys = g.groupBy("record_id", "name").agg(F.count(F.lit(1)).alias("n_keys"))
    rates = (both.join(per_tool, ["record_id", "name"], "left").join(n_keys, ["record_id", "name"], "left")
             .select("record_id",
                     *[_div(F.coalesce(c, F.lit(0)), F.coalesce("n_keys", F.lit(0))).alias(c) for c in "kcha"]))
    per_rec = rates.groupBy("record_id").agg(
        *[F.sum(c).alias(c) for c in "kcha"],
        F.count_if(F.col("k").isNull()).alias("undefined"))
    n_gt = prepared.filter(F.col("side") == "gt").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_gt"))
    out = _both_tool(items).join(per_rec, "record_id", "left").join(n_gt, "record_id", "left")
    ok = F.coalesce(F.col("undefined"), F.lit(0)) == 0

    def rate(c):
        return F.when(ok, _div(F.coalesce(c, F.lit(0.0)), F.coalesce("n_gt", F.lit(0))))

    return out.select("record_id",
                      rate("k").alias("score_variable_pickup_rate"),
                      rate("c").alias("score_variable_correct_rate"),
                      rate("h").alias("score_variable_hallucination_rate"),
                      rate("a").alias("score_variable_additional_rate"))


def exact_match(items: DataFrame, calls: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """O-64: 1.0 when both sides have the same number of calls and, after a
    stable sort by name, each pair has equal names and every truth flat key
    is present in the prediction with a matching value (extra predicted keys
    are ignored); 0.0 otherwise; NULL unless both sides are tool calls."""
    ranked = prepare_calls(calls)
    counts = ranked.groupBy("record_id").agg(F.count_if(F.col("side") == "gt").alias("n_g"),
                                            F.count_if(F.col("side") == "pred").alias("n_p"))
    g = ranked.filter(F.col("side") == "gt").select("record_id", "rank", F.col("name").alias("g_name"))
    p = ranked.filter(F.col("side") == "pred").select("record_id", "rank", F.col("name").alias("p_name"))
    name_bad = (g.join(p, ["record_id", "rank"])
                .groupBy("record_id").agg(F.count_if(~F.coalesce(F.col("g_name") == F.col("p_name"), F.lit(False)))
                                          .alias("bad_names")))
    flat = leaves if leaves is not None else call_leaves(ranked)
    gk = flat.filter(F.col("side") == "gt").select(
        "record_id", "rank", "key", F.col("type_tag").alias("g_tag"), F.col("str_val").alias("g_str"),
        F.col("num_val").alias("g_num"))
    pk = flat.filter(F.col("side") == "pred").select(
        "record_id", "rank", "key", F.col("type_tag").alias("p_tag"), F.col("str_val").alias("p_str"),
        F.col("num_val").alias("p_num"))
    match = values_match(F.col("g_tag"), F.col("g_str"), F.col("g_num"),
                         F.col("p_tag"), F.col("p_str"), F.col("p_num"))
    key_bad = (gk.join(pk, ["record_id", "rank", "key"], "left")
               .groupBy("record_id").agg(F.count_if(F.col("p_tag").isNull() | ~match).alias("bad_keys")))
    out = (_both_tool(items).join(counts, "record_id", "left").join(name_bad, "record_id", "left")
           .join(key_bad, "record_id", "left"))
    same_n = F.coalesce(F.col("n_g"), F.lit(0)) == F.coalesce(F.col("n_p"), F.lit(0))
    clean = (F.coalesce(F.col("bad_names"), F.lit(0)) == 0) & (F.coalesce(F.col("bad_keys"), F.lit(0)) == 0)
    return out.select("record_id", F.when(same_n & clean, 1.0).otherwise(0.0).alias("score_exact_match"))


def tool_scores_wide(items: DataFrame, calls: DataFrame, tools: DataFrame, params: DataFrame,
                     metrics: list[str] | None = None) -> DataFrame:
    """O-68: all tool metrics in one wide row per record.  ``metrics`` (names
    from ``METRICS``) selects columns; unknown names raise.  The predicted calls come
    among ``calls`` or, nested, in the items' ``pred_tools``.

    Computed by :func:`tool_scores_onepass` (one shuffle of the calls, one
    flattening, per-record evaluation); the per-metric operators above give
    the same values and are kept for single-metric use and cross-checks."""
    wanted = METRICS if metrics is None else list(metrics)
    unknown = [m for m in wanted if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown tool metrics: {unknown}")
    if any(m.startswith("variable_") or m == "exact_match" for m in wanted):
        out = tool_scores_onepass(items, calls, tools, params, wanted)
    else:
        if "pred_tools" in items.columns:
            calls = scoring_rows(items, calls).filter("side <> 'item'").drop("item")
        # No argument-level metric requested: no flattening at all.
        keep = [c for c in ("record_id", "gt_type", "pred_type", "raw_text", "raw_ok") if c in items.columns]
        it = by_key(items.select(*keep), "record_id")
        out = it.select("record_id", "gt_type", "pred_type", *_item_score_columns(it.columns))
        if any(m.startswith("tool_") for m in wanted):
            out = out.join(tool_pickup(it, calls, tools), "record_id", "left")
    return out.select("record_id", "gt_type", "pred_type", *[f"score_{m}" for m in wanted])


def alignment_report(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """O-47: records and outputs meet by ``record_id`` (never by position);
    one row with matched and unmatched counts on each side."""
    r = records.select("record_id", F.lit(True).alias("_r")).distinct()
    o = outputs.select("record_id", F.lit(True).alias("_o")).distinct()
    j = r.join(o, "record_id", "full_outer")
    return j.agg(F.count_if(F.col("_r").isNotNull()).alias("n_records"),
                 F.count_if(F.col("_o").isNotNull()).alias("n_outputs"),
                 F.count_if(F.col("_r").isNotNull() & F.col("_o").isNotNull()).alias("n_matched"),
                 F.count_if(F.col("_o").isNull()).alias("n_records_without_output"),
                 F.count_if(F.col("_r").isNull()).alias("n_outputs_without_record"))


def bucket_counts(items: DataFrame) -> DataFrame:
    """O-48: records per ground-truth bucket (tool / nlp)."""
    return items.groupBy("gt_type").agg(F.count(F.lit(1)).alias("n_records"))


def _leaf_match(g, p):
    """O-67 on leaves whose class (text | num | null | other) and lower-cased text were
    computed once per row."""
    return F.coalesce(
        F.when((g["cls"] == "null") | (p["cls"] == "null"), (g["cls"] == "null") & (p["cls"] == "null"))
        .when((g["cls"] == "text") & (p["cls"] == "text"), g["ls"] == p["ls"])
        .when((g["cls"] == "num") & (p["cls"] == "num"), F.abs(g["n"] - p["n"]) < F.lit(1e-9))
        .otherwise(F.lit(False)), F.lit(False))


def _item_struct(items: DataFrame):
    """What the record's row says of itself: types and the scores that follow from the item alone."""
    return F.struct(*[F.col(c).cast("string").alias(c) for c in ("gt_type", "pred_type")], *_item_score_columns(items.columns))


def scoring_rows(items: DataFrame, calls: DataFrame) -> DataFrame:
    """Items and calls as one stream: a row per call and one row (side ``item``) per item.
    Where items carry their predicted calls (``pred_tools``), each is read once."""
    none = F.lit(None).cast("string")
    item = _item_struct(items)
    call = F.struct(F.lit("item").alias("side"), F.lit(-1).alias("ordinal"), none.alias("name"), none.alias("arguments"), item.alias("item"))
    if "pred_tools" in items.columns:
        tools = F.coalesce("pred_tools", F.array().cast(items.schema["pred_tools"].dataType))
        empty = F.lit(None).cast(items.select(item.alias("i")).schema["i"].dataType)
        made = F.transform(tools, lambda c, i: F.struct(F.lit("pred").alias("side"), i.alias("ordinal"), c["name"].alias("name"),
                                                        c["arguments"].alias("arguments"), empty.alias("item")))
        rows = items.select("record_id", F.inline(F.concat(F.array(call), made)))
    else:
        rows = items.select("record_id", F.inline(F.array(call)))
    return rows.unionByName(calls.select("record_id", "side", F.col("ordinal").cast("int").alias("ordinal"), "name", "arguments"),
                            allowMissingColumns=True)


def tool_scores_onepass(items: DataFrame, calls: DataFrame, tools: DataFrame, params: DataFrame,
                        metrics: list[str] | None = None) -> DataFrame:
    """O-55..O-68 in one pass: the same values as the per-metric operators.  The scores of
    ``metrics`` (all by default) hold; others may not.

    Items and calls are one stream, hash-partitioned on ``record_id`` and ranked; only the calls
    of records with tool calls on both sides, the others having no call scores, are flattened.
    Catalogue flags come from broadcast joins, each call has a marker row besides its leaves.
    Python stages lose the partitioning, so calls and their nested leaves are partitioned on
    ``record_id`` again.  Truth and predicted leaves then meet by key: under the call's name
    (last call of a name: the variable metrics), under its rank (exact match), or once for
    both where a side has one call and the names agree.  All three levels of grouping --
    (record, call, key), (record, call), record -- start with ``record_id``, so none shuffles, and
    the work is linear (sorting aside) in the leaves of a record."""
    wanted = METRICS if metrics is None else metrics
    use_rank = "exact_match" in wanted
    use_name = any(m.startswith(("tool_", "variable_")) for m in wanted)
    is_item, is_gt, is_pred = (F.col("side") == x for x in ("item", "gt", "pred"))
    of_record = Window.partitionBy("record_id")              # in the order of the ranks: no further sort
    call_name = F.when(~is_item, F.col("name"))
    prepared = (prepare_calls(scoring_rows(items, calls)).withColumns({
        "n_gt": F.count_if(is_gt).over(of_record), "n_pred": F.count_if(is_pred).over(of_record),
        "one_name": F.min(call_name).over(of_record) == F.max(call_name).over(of_record),
        "scored": F.max((F.col("item.gt_type") == "tool") & (F.col("item.pred_type") == "tool")).over(of_record)})
        .filter(is_item | F.col("scored"))
        .withColumn("single", F.col("one_name") & (F.col("n_gt") <= 1) & (F.col("n_pred") <= 1))
        .withColumn("item", F.when(is_item, F.struct("item.*", "n_gt", "n_pred"))))
    cat = bounded_broadcast(tools.select("name", F.lit(True).alias("in_cat")).distinct())
    valid = bounded_broadcast(params.filter(~F.col("param").isin(*IGNORED_PARAMS))
                        .select(F.col("tool").alias("name"), F.col("param").alias("base_key"),
                                F.lit(True).alias("valid")).distinct())
    keep = ["record_id", "side", "name", "rank", "is_last", "single", "in_cat", "item"]
    rows = flatten_arguments(prepared.join(cat, "name", "left"), keep, call_rows=True, gather="record_id").join(
        valid, ["name", "base_key"], "left")
    leaf = F.struct(F.coalesce("valid", F.lit(False)).alias("valid"),
                    F.when(F.col("type_tag").isin("str", "list", "invalid"), "text")
                    .when(F.col("type_tag").isin("num", "bool"), "num")
                    .when(F.col("type_tag") == "null", "null").otherwise("other").alias("cls"),
                    F.lower(F.col("str_val")).alias("ls"), F.col("num_val").alias("n"))

    def place(by: str, call):
        return F.struct(F.lit(by).alias("by"), call.alias("call"))

    # A call's rows under its name (if it is the last of it) and under its rank; an item's row once.
    by_name, by_rank = place("name", F.col("name")), place("rank", F.col("rank").cast("string"))
    item_place = F.array(place("item", F.lit("")))
    ranks = F.array(by_rank) if use_rank else F.array().cast("array<struct<by:string,call:string>>")
    places = F.when(is_item, item_place)
    if use_name and use_rank:
        places = places.when(F.col("single"), F.array(place("both", F.col("name")))).when(F.col("is_last"), F.array(by_name, by_rank))
    elif use_name:
        places = places.when(F.col("is_last"), F.array(by_name))
    placed = rows.select("record_id", F.explode(places.otherwise(ranks)).alias("place"), "key", "side", "name", "in_cat", "item",
                         leaf.alias("leaf"))
    is_leaf = F.col("key").isNotNull()
    by_key_ = placed.groupBy("record_id", "place.by", "place.call", "key").agg(
        F.collect_list(F.when(is_leaf & is_gt, F.col("leaf"))).alias("g"),
        F.collect_list(F.when(is_leaf & is_pred, F.col("leaf"))).alias("p"),
        F.max(F.when(~is_leaf & is_gt, F.col("name"))).alias("gt_name"),
        F.max(F.when(~is_leaf & is_pred, F.col("name"))).alias("pred_name"),
        F.max(F.coalesce("in_cat", F.lit(False))).alias("in_cat"),
        F.first("item", ignorenulls=True).alias("item"))
    g, p = F.col("g"), F.col("p")
    known = F.filter(p, lambda x: x["valid"])
    met = F.size(g) > 0
    # Repeated keys of one call (dotted names that collide) are the only pairs compared here.
    by_call = by_key_.select(
        "record_id", "by", "call", "gt_name", "pred_name", "in_cat", "item", F.size(g).alias("n_keys"),
        F.when(met, F.size(known)).otherwise(0).alias("k"),
        F.size(F.filter(known, lambda x: F.exists(g, lambda y: _leaf_match(y, x)))).alias("c"),
        (F.size(p) - F.size(known)).alias("h"),
        F.when(met, 0).otherwise(F.size(known)).alias("a"),
        F.size(F.filter(g, lambda y: ~F.exists(p, lambda x: _leaf_match(y, x)))).alias("bad"),
    ).groupBy("record_id", "by", "call").agg(
        *[F.sum(x).alias(x) for x in ("n_keys", "k", "c", "h", "a", "bad")],
        F.max("gt_name").alias("gt_name"), F.max("pred_name").alias("pred_name"), F.max("in_cat").alias("in_cat"),
        F.first("item", ignorenulls=True).alias("item"))
    named, ranked = F.col("by").isin("name", "both"), F.col("by").isin("rank", "both")
    in_gt, in_pred = F.col("gt_name").isNotNull(), F.col("pred_name").isNotNull()
    both = named & in_gt & in_pred
    share = {x: F.sum(F.when(both, F.try_divide(F.col(x).cast("double"), F.col("n_keys").cast("double")))).alias(x) for x in "kcha"}
    record = by_call.groupBy("record_id").agg(
        F.first("item", ignorenulls=True).alias("item"),
        F.count_if(both).alias("n_both"), F.count_if(named & in_pred & ~F.col("in_cat")).alias("n_unknown"),
        F.count_if(named & in_pred & F.col("in_cat") & ~in_gt).alias("n_more"),
        F.count_if(both & (F.col("n_keys") == 0)).alias("undefined"), *share.values(),
        F.count_if(ranked & ((F.col("bad") > 0) | ~F.coalesce(F.col("gt_name") == F.col("pred_name"), F.lit(False)))).alias("unequal"))
    out = record.filter("item IS NOT NULL").select("record_id", "item.*", "*").drop("item")
    n_gt = F.col("n_gt").cast("double")

    def rate(n):
        return F.try_divide(n.cast("double"), n_gt)

    def var_rate(x):
        return F.when(F.col("undefined") == 0, rate(F.coalesce(F.col(x), F.lit(0.0))))

    exact = (F.col("n_gt") == F.col("n_pred")) & (F.col("unequal") == 0)
    scores = {"tool_pick_up_rate": rate(F.col("n_both")), "tool_hallucination_rate": rate(F.col("n_unknown")),
              "tool_additional_rate": rate(F.col("n_more")), "variable_pickup_rate": var_rate("k"),
              "variable_correct_rate": var_rate("c"), "variable_hallucination_rate": var_rate("h"),
              "variable_additional_rate": var_rate("a"), "exact_match": F.when(exact, 1.0).otherwise(0.0)}
    both_tool = (F.col("gt_type") == "tool") & (F.col("pred_type") == "tool")
    from_item = [f"score_{m}" for m in ("when2call", "schema_reliability_raw", "schema_reliability_processed")]
    return out.select("record_id", "gt_type", "pred_type", *from_item,
                      *[F.when(both_tool, v).alias(f"score_{m}") for m, v in scores.items()])


def _item_score_columns(columns: list[str]) -> list:
    """when2call and schema reliability as columns of the item row."""
    same = F.coalesce(F.col("gt_type"), F.lit("error")) == F.coalesce(F.col("pred_type"), F.lit("error"))
    gt_tool = F.col("gt_type") == "tool"
    raw_text = F.col("raw_text") if "raw_text" in columns else F.lit(None).cast("string")
    raw_ok = F.col("raw_ok") if "raw_ok" in columns else F.lit(False)
    raw = (F.when(~gt_tool | raw_text.isNull(), F.lit(None).cast("double"))
           .when(py_strip(raw_text) == "", 1.0)
           .when(F.coalesce(raw_ok, F.lit(False)), 1.0).otherwise(0.0))
    proc = F.when(gt_tool, F.when(F.col("pred_type") == "tool", 1.0).otherwise(0.0))
    return [F.when(same, 1.0).otherwise(0.0).alias("score_when2call"),
            raw.alias("score_schema_reliability_raw"), proc.alias("score_schema_reliability_processed")]
