"""Costly steps run once, however many branches read them, and equal texts are searched once."""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentrace.operators import graphs, kernel, library, logs
from agentrace.session import materialize
from agentrace.sources import readers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(df, column):
    """``df`` and an accumulator of how often ``column`` was computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def mark(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(mark, T.StringType()).asNondeterministic()(column)), seen


def test_search_reads_texts_once(spark):
    records, seen = counted(spark.createDataFrame([(i, f"red t{i % 3}") for i in range(30)], "record long, text string"), "text")
    queries = spark.createDataFrame([(i, f"T{i % 3} red red") for i in range(40)] + [(40, ""), (41, None)], "query_id long, query string")
    got = [tuple(r) for r in library.token_search(records, queries, "record", "text").collect()]
    assert sorted(got) == sorted((q, r) for q in range(40) for r in range(30) if q % 3 == r % 3)
    assert seen.value == 30


def test_pairs_of_equal_texts_and_queries_take_little_space(spark, tmp_path):
    texts = lambda n, start, key, text: spark.range(start, start + n).select(F.col("id").alias(key), F.lit(text).alias("text"))
    for few, many in (("record", "query_id"), ("query_id", "record")):
        n = {few: 200, many: 20000}
        records = texts(n["record"], 0, "record", "red bolt")
        queries = texts(n["query_id"], 50000, "query_id", "bolt Red").withColumnRenamed("text", "query")
        library.token_search(records, queries, "record", "text").write.parquet(f"{tmp_path}/{few}")
        found = spark.read.parquet(f"{tmp_path}/{few}")
        assert found.count() == found.distinct().count() == 4_000_000
        assert sum(f.stat().st_size for f in (tmp_path / few).glob("*.parquet")) < 0.5 * 4_000_000


def test_search_keeps_null_and_repeated_ids(spark):
    records = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b a"), (None, "a"), (2, "c")], "record long, text string")
    queries = spark.createDataFrame([(7, "B"), (None, "a"), (8, "b"), (9, "")], "query_id long, query string")
    got = sorted(map(str, map(tuple, library.token_search(records, queries, "record", "text").collect())))
    want = [(q, r) for q, t in ((7, "b"), (8, "b"), (None, "a")) for r, x in ((1, "ab"), (1, "ab"), (None, "ab"), (None, "a"), (2, "c")) if t in x]
    assert got == sorted(map(str, want))


def test_shuffles_go_with_the_table_they_were_for(spark):
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    kept = lambda: {b for b in blocks().mkString("\n").split("\n") if b.startswith("shuffle_")}
    before = kept()
    rows = materialize(spark.range(5000).repartition(3).groupBy((F.col("id") % 70).alias("k")).count(), "t")
    until = time.time() + 20
    while (left := kept() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and rows.count() == 70


def test_call_search_reads_calls_once(spark):
    tools = spark.createDataFrame([(1, "mail"), (2, "file")], "tool_id long, text string")
    rows = [(f"c{i}", 1 + i % 2, '{"n": %d}' % (i % 4)) for i in range(20)]
    calls, seen = counted(spark.createDataFrame(rows, "call_id string, tool_id long, arguments string"), "arguments")
    queries = spark.createDataFrame([("a", "mail", "2"), ("b", None, "n 3"), ("c", "file", "")], "query_id string, query string, argument_query string")
    got = {tuple(r) for r in library.call_search(tools, calls, queries).collect()}
    want = {("a", f"c{i}") for i in range(0, 20) if i % 4 == 2} | {("b", f"c{i}") for i in range(20) if i % 4 == 3}
    assert got == want | {("c", f"c{i}") for i in range(1, 20, 2)}
    assert seen.value == 20


def test_call_ids_are_made_of_found_calls_only(spark):
    tools = spark.createDataFrame([(1, "mail"), (2, "file")], "tool_id long, text string")
    many = " ".join(f"w{i}" for i in range(400))  # sets all bits of tokens
    rows = [(t, a) for t in (1, 2, 3, None) for a in ('{"n": 1}', '{"n": 2}', "{}", None, many)]
    calls = spark.createDataFrame(rows, "tool_id long, arguments string")
    asked = [("a", "mail", "n 2"), ("b", None, "1"), ("c", "file mail", "n"), ("d", "mail", "absent w7"), ("e", "", "w399 w3"), ("f", "file", None), ("g", "", "gone"), (None, "mail", "n")]
    queries = spark.createDataFrame(asked, "query_id string, query string, argument_query string")
    seen = spark.sparkContext.accumulator(0)

    def made(tool, arguments):
        seen.add(1)
        return f"{tool}/{arguments}"

    made_id = F.udf(made, T.StringType()).asNondeterministic()("tool_id", "arguments")
    found = library.call_search(tools, calls, queries, call_id=made_id, keep=["tool_id", "arguments"])
    got = found.collect()
    words = lambda x: set((x or "").replace('{"n": ', "n ").replace("}", "").split())
    names = {1: {"mail"}, 2: {"file"}, 3: set(), None: set()}
    want = [
        (q, f"{t}/{a}", t, a) for q, named, args in asked for t, a in rows
        if q and words(named) <= names[t] and (a in (None, "{}") or words(args) <= words(a))
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and seen.value == len(want) > 20


def test_null_ids_of_calls(spark):
    tools = spark.createDataFrame([(1, "mail")], "tool_id long, text string")
    calls = spark.createDataFrame([(None, 1, "{}"), (None, 1, '{"n": 2}'), ("c", 1, '{"n": 2}')], "call_id string, tool_id long, arguments string")
    queries = spark.createDataFrame([("a", "mail", "2"), ("b", "mail", ""), ("c", "", "n")], "query_id string, query string, argument_query string")
    got = [tuple(r) for r in library.call_search(tools, calls, queries).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a", "c"), ("b", None), ("b", None), ("b", "c"), ("c", "c")]))


def test_tools_that_come_twice(spark):
    tools = spark.createDataFrame([(1, "mail"), (1, "mail"), (2, "mail")], "tool_id long, text string")
    calls = spark.createDataFrame([("c", 1, "{}"), ("d", 1, '{"n": 2}'), ("e", 2, '{"n": 2}')], "call_id string, tool_id long, arguments string")
    queries = spark.createDataFrame([("a", "mail", "2"), ("b", "mail", "")], "query_id string, query string, argument_query string")
    got = sorted(tuple(r) for r in library.call_search(tools, calls, queries).collect())
    assert got == [("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "c"), ("b", "d"), ("b", "d"), ("b", "e")]


def test_overlap_joins_nothing_and_null_items_meet_nothing(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "x"), (None, "z")], "k long, item string")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (3, "x"), (None, "z")], "k long, item string")
    found = library.reference_overlap(e, a, ["k"], "item")
    assert {tuple(r) for r in found.collect()} == {(1, 3, 1, 2, 2), (2, 1, 0, 0, 1), (3, 0, 0, 1, 0), (None, 1, 0, 1, 1)}
    assert "Join" not in plan(found)


def test_arguments_of_a_trajectory_are_parsed_once(spark):
    log = spark.createDataFrame(
        [("r", 1, "tool_invocation", "t", "t", '{"k": 1}'), ("r", 2, "fixed_tool_response", "t", "t", None)],
        "run string, event_id long, type string, tool_id string, tool_name string, arguments string",
    )
    nodes, edges = graphs.trajectory_graph(log, ["run"])
    assert {(r.src, r.dst) for r in edges.collect()} == {("op:0", "tool:t"), ("op:0", "argument:k=1")}
    assert "parse_json" not in plan(edges).lower() and "parse_json" not in plan(nodes).lower()


def test_vectors_of_shared_graphs(spark):
    graph = spark.createDataFrame([("m", "t", "source", "s", r, 1, 2) for r in range(3)], "model string, task_id string, family string, form string, repeat int, g1 long, g2 long")
    features = spark.createDataFrame([(1, 2, 0, 7, 3)], "g1 long, g2 long, iteration int, feature long, n long")
    row = kernel.shared_vectors(graph, features, ["model", "task_id", "family", "form"]).collect()
    assert [(r.feature, r.c0, r.c1, r.c2, r._source) for r in row] == [(7, 3.0, 3.0, 3.0, True)]


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    for name, n in (("a", 700), ("b", 1), ("c", 0), ("d", 400)):
        folder = tmp_path / f"part={name}"
        folder.mkdir()
        (folder / "x.txt").write_text("".join(f"skip\n  {name}{i} \n" for i in range(n)))
    part = F.regexp_extract("file", "part=([a-z])/", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = readers.numbered_lines(spark, str(tmp_path), "^skip$", {"part": part})
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.part, r.row, r.line) for r in rows) == sorted(
        (name, i, f"{name}{i}") for name, n in (("a", 700), ("b", 1), ("d", 400)) for i in range(n)
    )
    # Only counts are windowed and shuffled, and the file's own column is made beside them.
    assert "row_number" not in plan(found).lower() and plan(found).count("regexp_extract") == 1


def test_calls_are_not_aggregated_by_sorting(spark):
    rows = [("r", 1, "tool_invocation", "t", None, "{}"), ("r", 2, "coverage_gap", "u", "u", None), ("r", 3, "fixed_tool_response", "t", "t", None),
            ("r", 4, "coverage_gap", "t", "t", None), ("r", 5, "tool_invocation", None, None, None), ("r", 6, "coverage_gap", None, "x", None),
            (None, 7, "fixed_tool_response", "t", "t", None), (None, 8, "tool_invocation", "t", "n", None)]
    log = spark.createDataFrame(rows, "run string, event_id long, type string, tool_id string, tool_name string, arguments string")
    found = logs.invocations(log, ["run"])
    got = {tuple(r) for r in found.select("run", "op_ord", "tool", "tool_id", "arguments", "outcome").collect()}
    assert got == {("r", 0, "t", "t", "{}", "success"), ("r", 1, "tool", None, None, "coverage_gap"), (None, 0, "n", "t", None, "unknown")}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
