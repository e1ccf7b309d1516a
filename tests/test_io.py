"""Readers, sinks and streams."""

import gzip
import json

from pyspark.sql import functions as F

from agentrace.functions.jsontree import leaves, resolve_pointer
from agentrace.operators import corpus, coding
from agentrace.operators import judging as J
from agentrace.sources import readers, sinks
from agentrace.operators.logs import invocations
from agentrace.streaming import logs, phrases


def test_archive_to_events_results_graphs(spark, tmp_path):
    run = "runs/main/m1/AIP-001/tone__p01/r2"
    events = '{"type": "tool_call", "tool": "a"}\n\n{"type": "tool_result", "tool": "a", "result": {"error": "x"}}\n'
    graph = {"name": "g", "nodes": [{"id": "op:0", "label": "l"}], "edges": [{"source": "op:0", "target": "op:0", "label": "r"}]}
    files = [
        (f"{run}/events.jsonl", events), (f"{run}/result.json", '{"status": "ok", "tool_calls": 3}'),
        (f"{run}/operation_graph.json", json.dumps(graph)), ("runs/main/m1/AIP-002/tone__p01/r0/result.json", "broken"),
        ("runs/notes.txt", "x"),
    ]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as out:
        out.writelines(json.dumps({"path": p, "content": c}) + "\n" for p, c in files)
    archive = readers.run_archive(spark, str(tmp_path))
    log = readers.event_log(archive).orderBy("event_id").collect()
    assert [(r.event_id, r.type, r.task_id, r.family, r.form, r.repeat) for r in log] == [
        (0, "tool_call", "AIP-001", "tone", "p01", 2), (2, "tool_result", "AIP-001", "tone", "p01", 2),
    ]
    assert json.loads(log[1].result) == {"error": "x"}
    assert [(r.task_id, r.tool_calls) for r in readers.run_results(archive).collect()] == [("AIP-001", 3)]
    nodes, edges = readers.operation_graphs(archive)
    assert nodes.first().node_id == "op:0" and edges.first().relation == "r"


def test_verdict_last_line_wins(spark):
    df = spark.createDataFrame([("e", 1, ["a"]), ("e", 2, ["b"]), ("f", 1, [])], "execution string, line_no int, leaked_items array<string>")
    assert {r.execution: r.leaked_items for r in readers.verdicts(df).collect()} == {"e": ["b"], "f": []}


def test_tool_names_from_both_quote_styles(spark):
    df = spark.createDataFrame([("[{'tool name': 'A b'}, {'tool name': \"C's\"}]",)], "t string")
    assert df.select(readers.tool_names(F.lit(None).cast("array<struct<name:string>>"), F.col("t"))).first()[0] == ["A b", "C's"]


def test_json_leaves_and_pointer(spark):
    doc = '{"a/b": {"c~d": [1, null, {"e": "x"}]}, "f": true}'
    df = spark.createDataFrame([(1, doc)], "k int, doc string")
    got = {(r.pointer, r.value) for r in leaves(df, "doc", ["k"]).collect()}
    assert got == {("/a~1b/c~0d/0", "1"), ("/a~1b/c~0d/1", "null"), ("/a~1b/c~0d/2/e", '"x"'), ("/f", "true")}
    assert df.select(resolve_pointer(F.col("doc"), "/a~1b/c~0d/2/e")).first()[0] == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5)], "k string, n int")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3
    report = sinks.write_with_report(df, f"{tmp_path}/pq", {"min": "1"}).first()
    assert report.rows == 3 and report.parameters["min"] == "1"
    sinks.write_frequencies(df, [F.desc("n"), F.asc("k")], f"{tmp_path}/freq", 2)
    top = spark.read.csv(f"{tmp_path}/freq/top", header=True).collect()
    assert {r.k for r in top} == {"b", "c"}
    full = spark.read.csv(f"{tmp_path}/freq/full", header=True).collect()
    assert {r.k: int(r.frequency_rank) for r in full} == {"b": 1, "c": 2, "a": 3}
    sinks.append_results(df, f"{tmp_path}/log", "k")
    sinks.append_results(df.unionByName(spark.createDataFrame([("d", 1)], df.schema)), f"{tmp_path}/log", "k")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_stream_equals_batch_over_several_arrivals(spark, tmp_path):
    schema = "conv_id long, turn long, role string, language string, text string"
    texts = ["Please help me now.", "please  HELP me now.", "Write a poem", "Please help me again", "", "Write a poem"]
    rows = [(i, 0, "user", "en", t) for i, t in enumerate(texts)] + [(9, 1, "assistant", "en", "no")]
    # Earlier places of known texts come later, in another language, in the same and in no language.
    rows += [(-1, 0, "user", "de", "WRITE a poem"), (-2, 0, "user", "de", "write a poem"), (None, 3, "user", None, "Please help me now.")]
    rows += [(7, 0, "user", "fr", "Write a poem")] * 2
    src = f"{tmp_path}/in"
    for chunk in (rows[:2], rows[2:5], rows[5:8], rows[8:]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        phrases.run_phrase_counts(stream, f"{tmp_path}/c1", f"{tmp_path}/o1")
        phrases.run_partial_counts(stream, f"{tmp_path}/c2", f"{tmp_path}/o2")
    batch = corpus.phrase_counts(corpus.dedup_turns(spark.createDataFrame(rows, schema)), 1)
    cols = ["language", "position", "n_tokens", "phrase", "turn_count"]
    versions = (
        phrases.latest_version(spark, f"{tmp_path}/o1"),
        phrases.merged_versions(spark, f"{tmp_path}/o2", phrases.PHRASE, "turn_count"),
    )
    for got in (v.select(*cols) for v in versions):
        assert got.exceptAll(batch.select(*cols)).count() == 0
        assert batch.select(*cols).exceptAll(got).count() == 0


def test_growing_logs_read_touched_buckets_only(spark, tmp_path):
    keys = ["model", "task_id", "family", "form", "repeat"]
    schema = "model string, task_id string, family string, form string, repeat int, event_id long, type string, tool_id string, tool_name string, arguments string"
    event = lambda t, i: ("m", t, "tone", "p01", 0, i, "tool_invocation", f"x{i}", f"x{i}", "{}")
    src, log, ops = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/ops"
    arrivals = ([event(f"t{i}", 5) for i in range(40)], [event("t3", 9), event("t3", 1)], [event("new", 2)])
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        logs.follow_logs(spark.readStream.schema(schema).parquet(src), f"{tmp_path}/c", log, ops, keys, 16)
    got = logs.current_operations(spark.read.parquet(ops), keys).select("task_id", "op_ord", "tool")
    whole = invocations(spark.createDataFrame(sum(arrivals, []), schema), keys).select("task_id", "op_ord", "tool")
    assert got.count() == 43 and got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    assert spark.read.parquet(ops).filter("batch = 1").count() == 3
    touched = logs.stored_events(spark.createDataFrame(arrivals[1], schema), log, 1, keys)
    filters = touched._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in filters and "batch#" in filters
    assert sorted(r.event_id for r in touched.collect()) == [1, 5, 9]


def test_traces_keep_their_place(spark, tmp_path):
    call = {
        "tool name": "t", "executed_output": {"a": [1]}, "domain name": "d", "API name": "x",
        "required parameters": [{"name": "q", "value": None}, {"name": 'k"', "value": "v"}],
        "optional parameters": [{"name": "q", "value": True}, {"value": 1}],
    }
    folder = tmp_path / "parallel" / "Some+a place"
    folder.mkdir(parents=True)
    lines = ["[", json.dumps({"tool list": [call, {"tool name": "u", "executed_output": "text"}]}) + ",", "null,", "",
             "{broken,", json.dumps({"tool list": [5, {}]}), "]"]
    (folder / "a.json").write_text("\n".join(lines))
    many = [json.dumps({"tool list": [{"tool name": str(i)}]}) for i in range(3000)]
    (folder / "b.json").write_text("\n".join(many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.tool_traces(spark, f"{tmp_path}/*/*")
        assert spark.read.text(f"{tmp_path}/*/*").rdd.getNumPartitions() > 2
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {(r.row, r.tool_index): r for r in rows if r.file.endswith("a.json")}
    assert sorted(first) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    r = first[0, 0]
    assert (r.domain, r.tool_name, r.tool_domain, r.parent_tool, r.api, r.output) == ("Some+a place", "t", "d", None, "x", '{"a":[1]}')
    assert json.loads(r.args) == {"q": True, 'k"': "v"} and first[0, 1].output == "text"
    assert first[3, 1].tool_name is None and first[3, 1].args == "{}" and first[3, 1].output is None
    assert sorted((r.row, r.tool_name) for r in rows if r.file.endswith("b.json")) == [(i, str(i)) for i in range(3000)]


def test_packing_never_splits_or_reorders(spark):
    rows = [("m", "t", "tone", f"f{i}", 100, s) for i, s in enumerate([50, 60, 500, 10, 10])]
    df = spark.createDataFrame(rows, "model string, task_id string, family string, form string, header_chars int, variant_chars int")
    got = J.pack_jobs(df, budget=J.FOOTER_CHARS + 100 + 120).orderBy("form").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 2]
    assert got[0].job_id == "m|t|tone|chunk00" and got[0].chunk_count == 3
    single = J.pack_jobs(df).collect()
    assert {r.job_id for r in single} == {"m|t|tone"}


def test_final_message_needs_text_and_no_call(spark):
    schema = (
        "k string, step int, source string, message string, "
        "tool_calls array<struct<function_name:string,arguments:string,tool_call_id:string>>"
    )
    call = [("bash", "{}", "c")]
    rows = [("a", 0, "agent", "first", None), ("a", 1, "agent", "with call", call), ("a", 2, "user", "u", None), ("b", 0, "agent", None, None)]
    got = coding.final_messages(spark.createDataFrame(rows, schema), ["k"]).collect()
    assert {r.k: r.final_message for r in got} == {"a": "first", "b": ""}


def test_leaves_of_documents_that_are_no_json(spark):
    docs = [(1, '{"a": [1, null]}'), (2, None), (3, "{broken"), (4, ""), (5, "null")]
    got = leaves(spark.createDataFrame(docs, "k int, doc string"), "doc", ["k"]).collect()
    assert sorted((r.k, r.pointer, r.value) for r in got) == [
        (1, "/a/0", "1"), (1, "/a/1", "null"), (2, None, None), (3, None, None), (4, None, None), (5, "", "null"),
    ]
