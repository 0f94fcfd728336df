"""Lookup-table sharding and connected components."""

import collections

import pytest
from hashlib import md5

from pyspark.sql import functions as F

from scorecraft.llm import components as C
from scorecraft.llm import sharding as S


def test_table_is_full_level_and_stable():
    names = [f"s{i}" for i in range(7)]
    table = S.lookup_table(names, 1009)
    share = collections.Counter(table)
    assert len(table) == 1009 and max(share.values()) - min(share.values()) <= 1
    fewer = S.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            S.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        S.lookup_table(names, 1000)


def test_assign_by_brute_force(spark):
    names = [f"s{i}" for i in range(5)]
    table = S.lookup_table(names, 101)
    rows = [(i, "x", 0) for i in range(50)] + [(None, "y", 1), (7, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    got = S.assign(df, "doc_id", names, 101).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert S.assign(df.limit(0), "doc_id", names, 101).count() == 0


def test_no_python_in_the_plan(spark):
    plan = S.assign(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b"], 101)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(20)], [(5, i) for i in range(30)], [(1, 2), (2, 1), (3, 4), (9, 4), (4, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in C.components(df).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    expected = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        expected[n] = min(seen)
    assert got == expected
    assert C.components(df).filter(F.col("component") > F.col("node")).isEmpty()
