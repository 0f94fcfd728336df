"""Tool-call metrics with hand-computed values (O-55..O-68)."""

import json

import pytest
from pyspark.sql import functions as F

from scorecraft.functions.arguments import flatten_arguments, simplify_calls, simplify_filter_keys
from scorecraft.operators import tool_metrics as T
from scorecraft.sources.catalog import catalog_documents, tool_params_dim, tools_dim, vllm_tools

SF_SMALL = "/root/testdata/sf0.001"

CATALOG = json.dumps([
    {"type": "function", "function": {"name": "pie", "parameters": {"properties": {
        "data_source": {}, "limit": {}, "title": {}}}}},
    {"name": "line", "properties": {"metric": {}, "limit": {}}},
])


def setup(spark, items, calls):
    it = spark.createDataFrame(items, "record_id long, gt_type string, pred_type string")
    c = spark.createDataFrame(calls, "record_id long, side string, ordinal int, name string, arguments string")
    docs = catalog_documents(spark, text=CATALOG)
    return it, c, tools_dim(docs), tool_params_dim(docs)


def wide(spark, items, calls):
    it, c, tools, params = setup(spark, items, calls)
    return {r.record_id: r for r in T.tool_scores_wide(it, c, tools, params).collect()}


def test_catalog_layouts(spark):
    docs = catalog_documents(spark, text=CATALOG)
    p = sorted((r.tool, r.param, r.required) for r in tool_params_dim(docs).collect())
    assert ("line", "metric", True) in p and ("pie", "data_source", True) in p and len(p) == 5


def test_references_and_request_tools(spark):
    doc = {"name": "t", "$defs": {"A": {"anyOf": [{"$ref": "#/$defs/B"}, {"type": "null"}]}, "B": {"type": "string", "enum": ["x", "y"]},
                                  "C": {"type": "object", "properties": {"again": {"$ref": "#/$defs/C"}}}},
           "parameters": {"properties": {"p": {"$ref": "#/$defs/A"}, "q": {"type": "array", "items": {"$ref": "#/$defs/B"}},
                                         "r": {"$ref": "#/$defs/C"}, "s": {"$ref": "#/$defs/none"}}}}
    docs = catalog_documents(spark, text=json.dumps([doc]))
    got = {r.param: (r.type, r.enum, r.required) for r in tool_params_dim(docs).collect()}
    assert got["p"] == ("string", ["x", "y"], True) and got["r"][0] == "object" and got["s"] == (None, None, True)
    tool = json.loads(vllm_tools(docs).collect()[0].tools_json)[0]["function"]
    assert tool["description"] == "" and set(tool["parameters"]["required"]) == {"p", "q", "r", "s"}
    assert tool["parameters"]["type"] == "object"
    assert tool["parameters"]["properties"]["q"]["items"] == {"type": "string", "enum": ["x", "y"]}


def test_calls_in_the_simplified_layout(spark):
    calls = [{"name": "t", "arguments": {"data_source": {"filter": {"payees": ["p"], "x": 1}, "source": "s"}, "l": [{"filter": {"categories": [1]}}]}},
             {"name": "u", "arguments": '{"filter": {"categories": ["c"]}}'}]
    df = spark.createDataFrame([(json.dumps(calls),), ("{bad",), (None,)], "tool_calls string")
    got = [r[0] for r in df.select(simplify_calls("tool_calls")).collect()]
    first = json.loads(got[0])
    assert first[0]["arguments"] == {"filter_payees": ["p"], "source": "s", "l": [{"filter_categories": [1]}]}
    assert json.loads(first[1]["arguments"]) == {"filter_categories": ["c"]}
    assert got[1:] == ["{bad", None]


def test_flatten_semantics(spark):
    c = spark.createDataFrame([(1, '{"a": {"b": 1, "title": "x", "c": {}}, "l": ["X", 1], "s": "S", "n": null, '
                                   '"t": true, "title": "y"}')], "record_id long, arguments string")
    got = {r.key: (r.type_tag, r.str_val, r.num_val) for r in flatten_arguments(c, ["record_id"]).collect()}
    assert got == {"a.b": ("num", None, 1.0), "l": ("list", '["X", 1]', None), "s": ("str", "S", None),
                   "n": ("null", None, None), "t": ("bool", None, 1.0)}


def test_flatten_by_json_rules(spark):
    """Any depth, the last of repeated names, NaN, list text, unreadable text."""
    rows = [(1, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1,"title":"x"}}}}}}}'), (2, '{"a":1,"a":2}'), (3, '{"a":NaN,"b":1}'),
            (4, '{"l":[1,1.0],"m":[{"z":1,"a":"\\ud83d"}]}'), (5, "{bad"), (6, None), (7, "[1]"), (8, "{}"),
            (9, '{"n":' + "9" * 400 + "}"), (10, '{"x":' * 30_000 + "1" + "}" * 30_000)]
    df = spark.createDataFrame(rows, "record_id long, arguments string")
    got: dict = {}
    for r in flatten_arguments(df, ["record_id"]).collect():
        got.setdefault(r.record_id, {})[r.key] = (r.type_tag, r.str_val, r.num_val)
    assert got[1] == {"a.b.c.d.e.f.g": ("num", None, 1.0)}
    assert got[2] == {"a": ("num", None, 2.0)}
    assert got[3]["a"][0] == "num" and got[3]["a"][2] != got[3]["a"][2] and got[3]["b"] == ("num", None, 1.0)
    assert got[4]["l"] == ("list", "[1, 1.0]", None) and got[4]["m"][0] == "list"
    assert got[5] == {"": ("invalid", "{bad", None)}
    assert not {6, 7, 8} & set(got)
    assert got[9] == {"n": ("num", None, float("inf"))}
    assert got[10][""][0] == "invalid"
    marked = flatten_arguments(df, ["record_id"], call_rows=True).filter("key IS NULL").count()
    assert marked == len(rows)


def test_simplified_filter_keys(spark):
    c = spark.createDataFrame([(1, '{"data_source": {"source": "tx", "filter": {"categories": ["a"], "x": 1}},'
                                   ' "filter": {"payees": ["p"]}, "limit": 2}')], "record_id long, arguments string")
    keys = sorted(r.key for r in simplify_filter_keys(flatten_arguments(c, ["record_id"])).collect())
    assert keys == ["filter_categories", "filter_payees", "limit", "source"]


def test_perfect_and_mismatched_calls(spark):
    r = wide(spark, [(1, "tool", "tool"), (2, "tool", "tool"), (3, "tool", "nlp"), (4, "nlp", "nlp")], [
        (1, "gt", 0, "pie", '{"data_source": {"type": "Spending"}, "limit": 5, "title": "a"}'),
        (1, "pred", 0, "pie", '{"data_source": {"type": "spending"}, "limit": 5.0, "title": "b"}'),
        # record 2: right tool, one wrong value, one hallucinated key, one additional key; plus an unknown tool
        (2, "gt", 0, "pie", '{"data_source": {"type": "income"}, "limit": 5}'),
        (2, "pred", 0, "pie", '{"data_source": {"type": "spending", "extra": 1}, "colour": "red"}'),
        (2, "pred", 1, "draw_map", '{}'),
        (3, "gt", 0, "line", '{"metric": "balance"}'),
    ])
    a = r[1]
    assert (a.score_when2call, a.score_exact_match, a.score_tool_pick_up_rate) == (1.0, 1.0, 1.0)
    assert (a.score_variable_pickup_rate, a.score_variable_correct_rate) == (1.0, 1.0)
    assert (a.score_variable_hallucination_rate, a.score_variable_additional_rate) == (0.0, 0.0)
    b = r[2]
    assert b.score_exact_match == 0.0
    assert (b.score_tool_pick_up_rate, b.score_tool_hallucination_rate, b.score_tool_additional_rate) == (1.0, 1.0, 0.0)
    # gt keys: data_source.type, limit (2).  pred keys: data_source.type (picked up, wrong),
    # data_source.extra (valid base key, not in gt: additional), colour (hallucinated).
    assert (b.score_variable_pickup_rate, b.score_variable_correct_rate) == (0.5, 0.0)
    assert (b.score_variable_hallucination_rate, b.score_variable_additional_rate) == (0.5, 0.5)
    c = r[3]
    assert c.score_when2call == 0.0 and c.score_exact_match is None and c.score_tool_pick_up_rate is None
    assert c.score_schema_reliability_processed == 0.0
    d = r[4]
    assert d.score_when2call == 1.0 and d.score_schema_reliability_processed is None


def test_duplicates_follow_three_rules(spark):
    r = wide(spark, [(1, "tool", "tool")], [
        (1, "gt", 0, "pie", '{"limit": 1}'),
        (1, "gt", 1, "pie", '{"limit": 2}'),
        (1, "pred", 0, "pie", '{"limit": 2}'),
        (1, "pred", 1, "pie", '{"limit": 1}'),
    ])[1]
    # pickup divides by the gt call count including duplicates: |{pie}| / 2
    assert r.score_tool_pick_up_rate == 0.5
    # variable metrics compare the last call per name (limit 2 vs limit 1), over 2 gt calls
    assert r.score_variable_correct_rate == 0.0 and r.score_variable_pickup_rate == 0.5
    # exact match pairs calls by stable rank: (1 vs 2) fails
    assert r.score_exact_match == 0.0


def test_gt_without_arguments_is_null(spark):
    r = wide(spark, [(1, "tool", "tool")], [(1, "gt", 0, "pie", "{}"), (1, "pred", 0, "pie", '{"limit": 1}')])[1]
    assert r.score_variable_pickup_rate is None
    assert r.score_exact_match == 1.0


@pytest.mark.parametrize("g,p,want", [
    ('"Abc"', '"aBC"', True), ("1", "1.0", True), ("true", "1", True), ("null", "null", True),
    ("null", "0", False), ('"1"', "1", False), ('["a","b"]', '["b","a"]', False), ('["A"]', '["a"]', True),
])
def test_values_match(spark, g, p, want):
    r = wide(spark, [(1, "tool", "tool")], [(1, "gt", 0, "pie", f'{{"limit": {g}}}'),
                                             (1, "pred", 0, "pie", f'{{"limit": {p}}}')])[1]
    assert r.score_variable_correct_rate == (1.0 if want else 0.0)


def test_unknown_metric_raises(spark):
    it, c, tools, params = setup(spark, [(1, "tool", "tool")], [(1, "gt", 0, "pie", "{}")])
    with pytest.raises(ValueError):
        T.tool_scores_wide(it, c, tools, params, ["no_such_metric"])


def test_repartition_invariance(spark):
    from scorecraft.plans import tool_plans
    it, calls = tool_plans.items(spark, SF_SMALL), tool_plans.calls(spark, SF_SMALL)
    docs = catalog_documents(spark, text=CATALOG)
    a = T.tool_scores_wide(it, calls, tools_dim(docs), tool_params_dim(docs))
    b = T.tool_scores_wide(it.repartition(3).orderBy(F.rand(1)), calls.repartition(5).orderBy(F.rand(2)),
                           tools_dim(docs), tool_params_dim(docs))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_onepass_equals_per_metric_operators(spark):
    from scorecraft.plans import tool_plans
    from scorecraft.plans.catalogs import fixture_catalog
    it, calls = tool_plans.items(spark, SF_SMALL), tool_plans.calls(spark, SF_SMALL)
    tools, params = fixture_catalog(spark)
    wide = {r.record_id: r for r in T.tool_scores_onepass(it, calls, tools, params).collect()}
    parts = [T.when2call(it), T.schema_reliability(it), T.tool_pickup(it, calls, tools),
             T.variable_metrics(it, calls, params), T.exact_match(it, calls)]
    for part in parts:
        for r in part.collect():
            for c in part.columns[1:]:
                assert wide[r.record_id][c] == r[c], (c, r.record_id)


def test_calls_meet_after_one_shuffle(spark):
    """Nothing is dealt by the keys or calls of a record, only by the record."""
    import re
    it, calls, tools, params = setup(spark, [(1, "tool", "tool")], [(1, "gt", 0, "pie", "{}")])
    plan = T.tool_scores_wide(it, calls, tools, params)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(record_id#\d+L?, (\S+?),? ", plan)
    assert dealt and all(n.rstrip(",)").isdigit() for n in dealt)


def test_chosen_metrics_equal_all(spark):
    """Records with one call a side, several, repeated names, other types, and none at all."""
    items = [(i, "tool", "tool") for i in range(1, 6)] + [(6, "tool", "nlp"), (7, "nlp", "tool"), (8, "tool", "tool")]
    one, two = '{"limit":1,"data_source":{"x":"a"}}', '{"limit":2,"odd":true,"data_source":{"x":"A"}}'
    calls = [(i, "gt", 0, "pie", one) for i in range(1, 8)] + [
        (1, "pred", 0, "pie", one), (2, "pred", 0, "line", one), (3, "pred", 0, "pie", two), (3, "pred", 1, "pie", one),
        (4, "pred", 0, "pie", two), (4, "pred", 1, "map", one), (4, "gt", 1, "line", two), (6, "pred", 0, "pie", one)]
    it, c, tools, params = setup(spark, items, calls)
    every = {r.record_id: r for r in T.tool_scores_wide(it, c, tools, params).collect()}
    assert len(every) == 8
    assert [every[i].score_exact_match for i in range(1, 9)] == [1.0, 0.0, 0.0, 0.0, 0.0, None, None, 1.0]
    assert [every[i].score_tool_hallucination_rate for i in (1, 4)] == [0.0, 0.5]
    for part in (T.tool_pickup(it, c, tools), T.variable_metrics(it, c, params), T.exact_match(it, c)):
        for r in part.collect():
            assert all(every[r.record_id][k] == r[k] for k in part.columns)
    for chosen in (["exact_match"], ["variable_pickup_rate", "tool_pick_up_rate"], ["when2call", "variable_correct_rate", "exact_match"]):
        for r in T.tool_scores_wide(it, c, tools, params, chosen).collect():
            assert all(every[r.record_id][f"score_{m}"] == r[f"score_{m}"] for m in chosen)


def test_vocabulary_is_broadcast_not_the_values(spark):
    from scorecraft.operators import domain as D
    from scorecraft.plans.catalogs import FREIGHT_CATALOG
    from scorecraft.sources.catalog import param_enum_dim
    calls = spark.range(40).selectExpr("id as record_id", "0 as ordinal", "'quote_freight' as name",
                                       """concat('{"mode":"', if(id % 4 = 0, 'rail', 'sea'), '"}') as arguments""")
    found = D.arg_domain_violations(calls, param_enum_dim(catalog_documents(spark, text=FREIGHT_CATALOG)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert [tuple(r) for r in found.collect()] == [("quote_freight", "mode", 40, 10)]
