"""Edge rules of logs and graph builders on hand-written events."""

import pytest
from pyspark.sql import functions as F

from agentrace.operators import graphs, logs

SCHEMA = (
    "k string, event_id long, type string, tool string, app string, field string, scope string, operation string, "
    "pointer string, destination string, recipient string, fields array<string>, authority string, error string, "
    "status string, result string"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def log_of(spark, events, key="k"):
    rows = [tuple({"k": key, "event_id": i, **e}.get(c) for c in COLUMNS) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def call(tool):
    return {"type": "tool_call", "tool": tool}


def request(**kw):
    return {"type": "permission_request", "app": "mail", "operation": "read", "scope": "once", **kw}


def grant(**kw):
    return {"type": "permission_grant", "app": "mail", "operation": "read", **kw}


def outcomes(spark, events, chunk):
    tagged = logs.annotate_calls(log_of(spark, events), ["k"], chunk)
    return [(r.op_ord, r.tool, r.outcome) for r in logs.operations(tagged, ["k"]).orderBy("op_ord").collect()]


def decisions(spark, events, chunk):
    tagged = logs.annotate_calls(log_of(spark, events), ["k"], chunk)
    rows = logs.grant_decisions(tagged, ["k"], chunk).orderBy("event_id").collect()
    return [r.decision for r in rows]


@pytest.fixture(params=[2, None])
def chunk(request):
    return request.param


def test_result_of_other_tool_is_ignored_and_error_wins(spark, chunk):
    events = [
        call("a"), {"type": "tool_result", "tool": "b", "result": '{"error": "x"}'},
        {"type": "tool_result", "tool": "a", "result": '{"ok": 1}'},
        call("b"), {"type": "tool_error", "result": '{"error": "Bad Thing"}'},
        {"type": "tool_result", "tool": "b", "result": "{}"},
        call("c"),
    ]
    assert outcomes(spark, events, chunk) == [
        (0, "a", "success"), (1, "b", "error:bad_thing"), (2, "c", "unknown"),
    ]


def test_failure_without_result_uses_the_event_itself(spark, chunk):
    events = [call("a"), {"type": "tool_error"}, call("b"), {"type": "tool_error", "error": "No Field"}]
    assert [o for _, _, o in outcomes(spark, events, chunk)] == ["success", "error:no_field"]


def test_status_members_of_results(spark, chunk):
    events = [
        call("a"), {"type": "tool_result", "tool": "a", "result": '{"status": "invalid_request"}'},
        call("a"), {"type": "tool_result", "tool": "a", "result": '{"status": "environment_coverage_gap"}'},
        call("a"), {"type": "tool_result", "tool": "a", "result": '["error"]'},
    ]
    assert [o for _, _, o in outcomes(spark, events, chunk)] == ["error:invalid_request", "coverage_gap", "success"]


def test_auxiliary_call_resets_active_operation(spark, chunk):
    events = [
        {"type": "access", "app": "early"}, call("a"), {"type": "access", "app": "x"}, call("list_apps"),
        {"type": "access", "app": "dropped"}, call("b"), {"type": "access", "app": "y"},
    ]
    _, edges = graphs.sandbox_graph(log_of(spark, events), ["k"], chunk)
    got = {(r.src, r.dst) for r in edges.filter("relation = 'ACCESSES'").collect()}
    assert got == {("op:0", "resource:x"), ("op:1", "resource:y")}


def test_tool_error_without_call_makes_no_node(spark, chunk):
    nodes, edges = graphs.sandbox_graph(log_of(spark, [{"type": "tool_error", "error": "unknown tool"}]), ["k"], chunk)
    assert nodes.count() == 0 and edges.count() == 0


def test_decisions(spark, chunk):
    deny = {"type": "permission_deny"}
    cases = [
        ([call("a"), request(), grant()], ["granted"]),
        ([call("a"), request(), grant(authority="sandbox_auto_grant")], ["auto_granted"]),
        ([call("a"), request(), deny, grant()], ["denied"]),
        ([call("a"), request(), grant(), deny], ["granted"]),
        ([call("a"), request(destination="d"), grant()], ["not_granted"]),
        ([call("a"), request(pointer=None), grant(pointer=None)], ["granted"]),
        ([call("a"), request(), call("b"), grant()], ["not_granted"]),
        ([call("a"), grant(), request()], ["not_granted"]),
        ([call("a"), request(), request(), grant()], ["granted", "granted"]),
    ]
    for events, want in cases:
        assert decisions(spark, events, chunk) == want, events


def test_parallel_edges_stay_and_nodes_are_unique(spark, chunk):
    events = [call("a"), {"type": "access", "app": "x", "fields": ["f", "f"]}]
    nodes, edges = graphs.sandbox_graph(log_of(spark, events), ["k"], chunk)
    assert edges.filter("relation = 'READS'").count() == 2
    assert nodes.filter("node_id = 'field:x:f'").count() == 1


def test_invocation_outcomes_and_arguments(spark):
    rows = [
        ("k", 0, "tool_invocation", "t1", "Tool One", '{"a": 1, "b": "X y", "c": [1], "d": null, "e": true}'),
        ("k", 1, "fixed_tool_response", "t2", None, None),
        ("k", 2, "coverage_gap", "t1", None, None),
        ("k", 3, "fixed_tool_response", "t1", None, None),
        ("k", 4, "tool_invocation", "t2", "Tool Two", None),
        ("k", 5, "tool_invocation", "t2", "Tool Two", "{}"),
        ("k", 6, "fixed_tool_response", "t2", None, None),
    ]
    log = spark.createDataFrame(rows, "k string, event_id long, type string, tool_id string, tool_name string, arguments string")
    nodes, edges = graphs.trajectory_graph(log, ["k"], 2)
    labels = {r.node_id: r.label for r in nodes.collect()}
    assert labels["op:0"] == "op:tool_one|outcome:coverage_gap"
    assert labels["op:1"] == "op:tool_two|outcome:unknown"
    assert labels["op:2"] == "op:tool_two|outcome:success"
    args = {r.dst for r in edges.filter("relation = 'HAS_ARGUMENT'").collect()}
    assert args == {"argument:a=1", "argument:b=x_y", "argument:d=null", "argument:e=true"}
    assert edges.filter(F.col("relation") == graphs.PRECEDES).count() == 2


def test_routing(spark):
    rows = [("a", "tool_invocation", None), ("b", "permission_request", "f"), ("c", "tool_call", None)]
    got = logs.route_builder(spark.createDataFrame(rows, "k string, type string, field string"), ["k"])
    assert {r.k: r.builder for r in got.collect()} == {"a": "trajectory", "b": "permission", "c": "sandbox"}
