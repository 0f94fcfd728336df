"""foreachBatch glue: response files arriving over time are parsed by the
batch operators, with progress kept in a checkpoint folder."""

import json

from scorecraft.operators import parsing as P
from scorecraft.streaming import score_new_responses


def test_score_new_responses(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = f"record_id long, content string, tool_calls {P.NATIVE_CALLS_TYPE.simpleString()}, error string"
    rows = [{"record_id": 1, "content": '{"name": "show_pie_chart", "parameters": {"limit": 2}}'},
            {"record_id": 2, "content": "plain text"}]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    out = str(tmp_path / "out")

    def sink(df, epoch):
        df.write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).json(str(src))
    q = score_new_responses(stream, lambda df: P.parse_outputs(df, "json").drop("pred_tools"), sink,
                            str(tmp_path / "ckpt"))
    q.processAllAvailable()
    (src / "b.json").write_text(json.dumps({"record_id": 3, "error": "timeout"}))
    q.processAllAvailable()
    q.stop()
    got = {r.record_id: r.pred_type for r in spark.read.parquet(out).collect()}
    assert got == {1: "tool", 2: "nlp", 3: "error"}
