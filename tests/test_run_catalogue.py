import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft import sinks
from scorecraft.operators import analysis as A
from scorecraft.operators import parsing as P
from scorecraft.session import shared_folder
from scorecraft.sources import runs


@pytest.fixture()
def root(spark, tmp_path):
    """Model a in two runs, model b in one; columns and types differ."""
    def write(ts, model, text, rows):
        sinks.write_per_item_results(spark.createDataFrame(rows, text), str(tmp_path), ts, model, "tool_calling", csv=True)

    write("2026-01-01", "a", "record_id int, score_x double", [(1, 0.5)])
    write("2026-01-02", "a", "record_id int, score_x int", [(1, 2), (2, None)])
    write("2026-01-01", "b", "record_id long, score_x double, score_y int", [(5_000_000_000, 0.25, 7)])
    return str(tmp_path)


def test_runs_with_other_columns_and_types_are_one_frame(spark, root):
    df = runs.scan_runs(spark, root, "tool_calling")
    assert dict(df.dtypes) == {"run_ts": "string", "model": "string", "benchmark": "string",
                               "record_id": "bigint", "score_x": "double", "score_y": "int"}
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted([("2026-01-01", "a", "tool_calling", 1, 0.5, None), ("2026-01-02", "a", "tool_calling", 1, 2.0, None),
                          ("2026-01-02", "a", "tool_calling", 2, None, None),
                          ("2026-01-01", "b", "tool_calling", 5_000_000_000, 0.25, 7)], key=str)


def test_newest_runs_read_only_their_files(spark, root):
    df = runs.scan_newest_runs(spark, root, "tool_calling")
    assert {(r.run_ts, r.model) for r in df.collect()} == {("2026-01-02", "a"), ("2026-01-01", "b")}
    read = df.inputFiles()
    assert read and not any("2026-01-01/a/" in f for f in read)


def test_known_runs_are_not_opened_again(spark, root):
    first = runs.run_catalogue(spark, root, "tool_calling")
    rows = first.collect()
    assert len(rows) == 3 and first.columns == ["run_ts", "model", "benchmark", "path", "schema"]
    marked = spark.createDataFrame([(*r[:4], '{"type":"struct","fields":[]}') for r in rows], runs.CATALOGUE)
    again = runs.run_catalogue(spark, root, "tool_calling", known=marked)
    assert {r.schema for r in again.collect()} == {'{"type":"struct","fields":[]}'}


def test_no_runs_and_unlike_types(spark, root):
    none = runs.run_catalogue(spark, root, "tool_calling").filter("false")
    assert runs.read_runs(spark, none).collect() == []
    kinds = {("int", "bigint"): "bigint", ("tinyint", "int"): "int", ("int", "float"): "double", ("float", "double"): "double",
             ("void", "string"): "string", ("string", "void"): "string", ("array<int>", "array<int>"): "array<int>"}
    for (x, y), z in kinds.items():
        a, b = (T.StructType.fromDDL(f"c {t}").fields[0].dataType for t in (x, y))
        assert runs.wider_type("c", a, b).simpleString() == z
    with pytest.raises(ValueError, match="'c': string and int"):
        runs.wider_type("c", T.StringType(), T.IntegerType())


def test_shared_folder_is_new_each_time(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_parse_failures_are_the_same_rows_in_any_order(spark):
    rows = [(i, "bad" if i % 3 else None, "s" if i % 2 else "t", f"text {i}") for i in range(300)] + [(1, "bad", "s", "text 1")]
    df = spark.createDataFrame(rows, "record_id long, pred_error string, parse_strategy string, raw_text string").withColumn("g", F.lit("g"))
    one = sorted(map(tuple, P.parse_failures(df, ["g"], 4).collect()))
    two = sorted(map(tuple, P.parse_failures(df.repartition(7).orderBy(F.desc("record_id")), ["g"], 4).collect()))
    assert one == two and len(one) == 8 and {r[-1] for r in one} == {1, 2, 3, 4}
    assert P.parse_failures(df.filter("pred_error IS NULL"), ["g"], 4).collect() == []


def test_models_in_order(spark):
    df = spark.createDataFrame([("2", "a"), ("1", "b"), ("1", "a"), ("2", "a")], "run_ts string, model string")
    assert sorted(map(tuple, A.model_positions(df).collect()), key=lambda r: r[2]) == [("1", "a", 0), ("1", "b", 1), ("2", "a", 2)]
