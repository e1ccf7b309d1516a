"""Nothing is cut off: sentences, paths, calls of a step, repeats, long logs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from agentrace.functions import phrases
from agentrace.operators import coding, kernel, library, stats
from agentrace.operators.ordered import running
from agentrace.plans.incremental import table_stream


def test_all_sentences_and_paths_count(spark):
    text = ". ".join(f"s{i}" for i in range(40)) + "."
    paths = " ".join(f"d/f{i:02}.py" for i in range(30))
    row = (
        spark.createDataFrame([(text, paths)], "t string, p string")
        .select(F.size(phrases.sentences(F.col("t"))), F.size(coding.paths(F.col("p"))))
        .first()
    )
    assert tuple(row) == (40, 30)


def test_more_calls_of_a_step_than_4096(spark):
    calls = F.transform(
        F.sequence(F.lit(0), F.lit(4999)),
        lambda i: F.struct(
            F.lit("todowrite").alias("function_name"),
            F.lit("{}").alias("arguments"),
            i.cast("string").alias("tool_call_id"),
        ),
    )
    none = F.array().cast("array<struct<source_call_id:string,content:string>>")
    steps = spark.range(2).select(
        F.lit("t").alias("task_id"),
        F.col("id").alias("step"),
        F.lit("agent").alias("source"),
        calls.alias("tool_calls"),
        F.struct(none.alias("results")).alias("observation"),
    )
    got = coding.step_calls(steps, ["task_id"]).select("event_id")
    assert got.distinct().count() == 10_000


def test_command_lists(spark):
    commands = [
        {"command": ["bash", "-lc", "cat a/b.txt"]},
        {"command": ["ls", "x/y"]},
        {"command": "", "cmd": "git status"},
        {"command": [], "cmd": "rm a/b"},
    ]
    rows = [("t", i, "bash", json.dumps(c), "") for i, c in enumerate(commands)]
    df = spark.createDataFrame(rows, "t string, event_id long, function_name string, arguments string, observed string")
    ops = coding.call_operations(df, ["t"]).orderBy("op_ord").collect()
    assert [r.program for r in ops] == ["cat", "ls", "git", "rm"]


def test_a_fourth_run_is_refused(spark):
    runs = spark.createDataFrame([("t", r) for r in range(4)], "task_id string, repeat int")
    assert kernel.run_presence(runs.where("repeat < 3"), ["task_id"]).first().h2
    with pytest.raises(Exception, match="not a repeat of three"):
        kernel.run_presence(runs, ["task_id"]).collect()


def test_errors_that_are_texts(spark):
    outputs = ['{"error": "false"}', '{"error": "0"}', '{"errors": "[]"}', '{"error": ""}', '{"error": false}', "plain"]
    df = spark.createDataFrame([(o,) for o in outputs], "o string")
    got = df.select(library.usable_response(F.col("o"), F.lit(None).cast("string")).alias("u")).collect()
    assert [r.u for r in got] == [False, False, False, True, True, True]


def test_logs_are_cut_wherever_their_ids_lie(spark):
    rows = [("short", 10**9 * i, 1) for i in range(4)] + [("long", 7 + 10**6 * i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, pos long, n int")
    for r in running(df, ["k"], "pos", sums={"total": F.col("n")}, parts=10).collect():
        assert r.total == (r.pos // 10**9 if r.k == "short" else (r.pos - 7) // 10**6) + 1


def test_groups_of_equal_size_draw_differently(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in "abc" for i in range(20)], "g string, u long, v double")
    means = stats.bootstrap_means(df, ["g"], "u", "v", 50).orderBy("replicate").collect()
    by_group = {g: [r.estimate for r in means if r.g == g] for g in "abc"}
    assert by_group["a"] != by_group["b"] != by_group["c"]
    assert all(len(set(m)) > 20 for m in by_group.values())


def test_streams_read_folders_of_part_files(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    query = table_stream(spark, str(tmp_path), "events").writeStream.format("memory").queryName("folder_stream")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("folder_stream").distinct().count() == 100


def test_rarest_token_search(spark):
    records = spark.createDataFrame([(i, f"common t{i % 5} r{i}") for i in range(50)], "record long, text string")
    queries = spark.createDataFrame([(1, "common t3"), (2, "r7 common"), (3, "absent common")], "query_id long, query string")
    got = {(r.query_id, r.record) for r in library.token_search(records, queries, "record", "text").collect()}
    assert got == {(1, i) for i in range(3, 50, 5)} | {(2, 7)}


def test_calls_are_found_by_both_fields(spark):
    tools = spark.createDataFrame([(1, "mail Send"), (2, "mail read"), (3, "")], "tool_id long, text string")
    bodies = ['{"to":"ann","n":-5}', '{"to":"bob"}', "{}", None, '{"":""}', '{"to":"ann"}']
    rows = [(f"c{t}{i}", t, b) for t in (1, 2, 3) for i, b in enumerate(bodies)]
    calls = spark.createDataFrame(rows, "call_id string, tool_id long, arguments string")
    asked = [("a", "MAIL", "to ann"), ("b", "mail send", None), ("c", None, "-5 n"), ("d", "", "to to absent"),
             ("e", "absent", "to"), ("f", "", ""), ("g", "read", "5")]
    queries = spark.createDataFrame(asked, "query_id string, query string, argument_query string")
    words = lambda x: set(re.findall(r"-?\d+|[a-z]+", (x or "").lower()))
    texts = {1: "mail Send", 2: "mail read", 3: ""}
    want = {
        (q, c) for q, named, args in asked for c, t, b in rows
        if (words(named) or words(args)) and words(named) <= words(texts[t])
        and (b in (None, "{}") or words(args) <= words(b))
    }
    got = [tuple(r) for r in library.call_search(tools, calls, queries).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert library.call_search(tools, calls.filter("false"), queries).count() == 0
    page = library.search_page(calls, ["arguments", "call_id"], 4, 3).orderBy("position").collect()
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
    assert [(r.call_id, r.position, r.total) for r in page] == [(order[i][0], i + 1, 18) for i in (4, 5, 6)]
