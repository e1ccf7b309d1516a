"""Queries over logs, operation graphs, the graph kernel and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentrace.operators import graphs, kernel, logs, summaries
from agentrace.plans import fixture_sql as S
from agentrace.plans.registry import query
from agentrace.sources.tables import (
    RUN_KEYS,
    permission_log,
    runs_base,
    sandbox_log,
    stored_runs,
    tool_log,
)

TASK_KEYS = ("model", "task_id")
LONG = ("user_id",)
NOT_STRICT = ("n02", "lang_de")


def long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sandbox events of a user as one long log."""
    return sandbox_log(runs_base(spark, sf_dir))


def tool_graph(spark: SparkSession, sf_dir: str, base: DataFrame | None = None):
    base = base or stored_runs(spark, sf_dir)
    nodes, edges = graphs.trajectory_graph(tool_log(base), RUN_KEYS)
    return base, nodes, edges


def run_pairs(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    base, nodes, edges = tool_graph(spark, sf_dir, base)
    vectors = kernel.shared_vectors(
        *kernel.shared_features(nodes, edges, RUN_KEYS), [*TASK_KEYS, "family", "form"]
    )
    return kernel.pair_scores(vectors, base.select(*RUN_KEYS), TASK_KEYS)


def variants(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    return summaries.variant_scores(run_pairs(spark, sf_dir, base), TASK_KEYS)


def task_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).withColumn("strict_mt_eligible", ~F.col("form").isin(*NOT_STRICT))
    return summaries.task_family_scores(summaries.with_subsets(v), TASK_KEYS)


@query(
    "event_segments",
    f"""WITH {S.SEGMENTS} SELECT user_id, event_id, type, segment::BIGINT AS segment, op_count::BIGINT AS op_count FROM seg""",
)
def event_segments(spark, sf_dir):
    tagged = logs.annotate_calls(long_log(spark, sf_dir), LONG)
    return tagged.select("user_id", "event_id", "type", "segment", "op_count")


@query(
    "active_operation",
    f"""WITH {S.SEGMENTS} SELECT user_id, active_op::BIGINT AS active_op, type, count(*) AS n FROM act GROUP BY ALL""",
)
def active_operation(spark, sf_dir):
    tagged = logs.annotate_calls(long_log(spark, sf_dir), LONG)
    return tagged.groupBy("user_id", "active_op", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "long_log_operations",
    f"""WITH {S.BASE}, {S.SANDBOX_LOG}
    SELECT substr(task_id, 1, 4) AS benchmark, event_id, type,
      count(*) FILTER (type IN ('tool_call','agent_tool_call')) OVER w AS segment,
      count(*) FILTER (type = 'tool_call' AND tool <> 'list_apps') OVER w AS op_count,
      last_value(CASE WHEN type = 'tool_call' THEN tool END IGNORE NULLS) OVER w AS latest_tool
    FROM log WINDOW w AS (PARTITION BY substr(task_id, 1, 4) ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def long_log_operations(spark, sf_dir):
    """All sandbox events of a benchmark as one log: three logs over thirty-two ranges."""
    log = long_log(spark, sf_dir).withColumn("benchmark", F.substring("task_id", 1, 4))
    tagged = logs.annotate_calls(log, ["benchmark"], parts=32)
    return tagged.select(
        "benchmark", "event_id", "type", "segment", "op_count", F.col("call.tool").alias("latest_tool")
    )


@query(
    "next_result_status",
    f"""WITH {S.SEGMENTS} SELECT user_id, op_ord::BIGINT AS op_ord, tool, outcome FROM sops""",
)
def next_result_status(spark, sf_dir):
    ops = logs.operations(logs.annotate_calls(long_log(spark, sf_dir), LONG), LONG)
    return ops.select("user_id", "op_ord", "tool", "outcome")


@query(
    "grant_decision",
    f"""WITH {S.DECISIONS} SELECT user_id, event_id, segment::BIGINT AS segment, app, decision FROM dec""",
)
def grant_decision(spark, sf_dir):
    tagged = logs.annotate_calls(long_log(spark, sf_dir), LONG)
    return logs.grant_decisions(tagged, LONG).select("user_id", "event_id", "segment", "app", "decision")


@query(
    "invocation_outcomes",
    f"""WITH {S.TOOL_OPS} SELECT model, task_id, family, form, repeat, op_ord, tool, outcome FROM ops""",
)
def invocation_outcomes(spark, sf_dir):
    ops = logs.invocations(tool_log(runs_base(spark, sf_dir)), RUN_KEYS)
    return ops.select(*RUN_KEYS, "op_ord", "tool", "outcome")


@query(
    "op_precedence",
    f"""WITH {S.TOOL_EDGES} SELECT model, task_id, family, form, repeat, src, dst FROM edges WHERE relation = 'DIRECTLY_PRECEDES'""",
)
def op_precedence(spark, sf_dir):
    _, _, edges = tool_graph(spark, sf_dir)
    return edges.filter(F.col("relation") == graphs.PRECEDES).select(*RUN_KEYS, "src", "dst")


@query("tool_graph_nodes", f"""WITH {S.TOOL_GRAPH} SELECT * FROM nodes""")
def tool_graph_nodes(spark, sf_dir):
    return tool_graph(spark, sf_dir)[1]


@query("tool_graph_edges", f"""WITH {S.TOOL_EDGES} SELECT * FROM edges""")
def tool_graph_edges(spark, sf_dir):
    return tool_graph(spark, sf_dir)[2]


@query(
    "permission_graph_edges",
    f"""WITH {S.BASE},
    plog AS (SELECT *, CASE WHEN event_type = 'click' THEN CASE WHEN k % 4 = 3 THEN 'list_private_fields' ELSE 'plan_' || (k % 4) END END AS tool
             FROM base WHERE event_type IN ('click','signup')),
    pseg AS (SELECT *, sum(CASE WHEN tool <> 'list_private_fields' THEN 1 ELSE 0 END) OVER w AS op_count,
               last_value(tool IGNORE NULLS) OVER w AS call_tool FROM plog
             WINDOW w AS (PARTITION BY model, task_id, family, form, repeat ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    pact AS (SELECT *, CASE WHEN call_tool <> 'list_private_fields' THEN op_count - 1 END AS active_op FROM pseg)
    SELECT model, task_id, family, form, repeat, 'op:' || (op_count - 1) AS src, 'tool:' || tool AS dst, 'USES' AS relation
      FROM pact WHERE tool <> 'list_private_fields'
    UNION ALL SELECT model, task_id, family, form, repeat, 'op:' || (op_count - 2), 'op:' || (op_count - 1), 'DIRECTLY_PRECEDES'
      FROM pact WHERE tool <> 'list_private_fields' AND op_count > 1
    UNION ALL SELECT model, task_id, family, form, repeat, 'op:' || active_op, 'field:f' || (k % 6),
      'REQUESTS:read|scope=' || (['once','persistent'])[k % 2 + 1] FROM pact WHERE event_type = 'signup' AND active_op IS NOT NULL""",
)
def permission_graph_edges(spark, sf_dir):
    return graphs.permission_graph(permission_log(runs_base(spark, sf_dir)), RUN_KEYS)[1]


@query("sandbox_graph_edges", f"""WITH {S.SANDBOX_EDGES} SELECT * FROM sedges""")
def sandbox_graph_edges(spark, sf_dir):
    return graphs.sandbox_graph(long_log(spark, sf_dir), LONG)[1]


@query("sandbox_graph_nodes", f"""WITH {S.SANDBOX_EDGES} SELECT * FROM snodes""")
def sandbox_graph_nodes(spark, sf_dir):
    return graphs.sandbox_graph(long_log(spark, sf_dir), LONG)[0]


@query(
    "graph_records",
    f"""WITH {S.SANDBOX_EDGES}
    SELECT user_id, 'node' AS part, '{{"id":"' || node_id || '","label":"' || label || '"}}' AS record FROM snodes
    UNION ALL SELECT user_id, 'edge', '{{"source":"' || src || '","target":"' || dst || '","label":"' || relation || '"}}' FROM sedges""",
)
def graph_records(spark, sf_dir):
    return graphs.serialize(*graphs.sandbox_graph(long_log(spark, sf_dir), LONG), LONG)


@query(
    "builder_route",
    f"""WITH {S.BASE}, allrows AS (
      SELECT task_id, event_type = 'click' AND k % 2 = 0 AS inv, event_type = 'signup' AND k % 3 = 0 AS fld FROM base)
    SELECT task_id, CASE WHEN bool_or(inv AND task_id LIKE 'TJB-%') THEN 'trajectory'
       WHEN bool_or(fld AND task_id NOT LIKE 'ACB-%') THEN 'permission' ELSE 'sandbox' END AS builder
    FROM allrows GROUP BY task_id""",
)
def builder_route(spark, sf_dir):
    base = runs_base(spark, sf_dir)
    et, k = F.col("event_type"), F.col("k")
    mixed = base.select(
        "task_id",
        F.when((et == "click") & (k % 2 == 0) & F.col("task_id").startswith("TJB-"), "tool_invocation")
        .when(et == "signup", "permission_request")
        .otherwise("tool_call")
        .alias("type"),
        F.when((et == "signup") & (k % 3 == 0) & ~F.col("task_id").startswith("ACB-"), "f").alias("field"),
    )
    return logs.route_builder(mixed, ["task_id"])


@query(
    "graph_validation",
    f"""WITH {S.SANDBOX_EDGES},
    badnodes AS (SELECT user_id, node_id, label FROM snodes WHERE node_id NOT LIKE 'state:%'
                 UNION ALL SELECT user_id, node_id, label || '!' FROM snodes WHERE node_id LIKE 'op:%7')
    SELECT user_id, 'conflicting_label' AS problem, node_id FROM badnodes GROUP BY ALL HAVING min(label) <> max(label)
    UNION ALL
    SELECT DISTINCT user_id, 'dangling_endpoint', dst FROM sedges WHERE dst LIKE 'state:%'""",
)
def graph_validation(spark, sf_dir):
    """Both rules on graphs damaged on purpose: state nodes dropped, some operations relabelled."""
    nodes, edges = graphs.sandbox_graph(long_log(spark, sf_dir), LONG)
    damaged = nodes.filter(~F.col("node_id").startswith("state:")).unionByName(
        nodes.filter(F.col("node_id").rlike("^op:.*7$")).withColumn("label", F.concat("label", F.lit("!")))
    )
    return graphs.validation_report(damaged, edges, LONG)


PROJECTION = f"""{S.SANDBOX_EDGES},
tagged AS (
  SELECT user_id, dimension, src, dst, relation,
    CASE dimension WHEN 'permission' THEN relation LIKE 'REQUESTS:%'
      WHEN 'information' THEN relation IN ('ACCESSES','READS','DISCLOSES_TO','HAS_OUTPUT')
      ELSE relation IN ('USES','HAS_ARGUMENT','CHANGES_STATE') END AS prim
  FROM sedges, (SELECT unnest(['permission','information','tool']) AS dimension)),
sel AS (
  SELECT DISTINCT user_id, dimension, op FROM (
    SELECT user_id, dimension, src AS op FROM tagged WHERE prim UNION ALL SELECT user_id, dimension, dst FROM tagged WHERE prim)
  WHERE op LIKE 'op:%' AND dimension <> 'tool'
  UNION ALL SELECT user_id, 'tool', node_id FROM snodes WHERE label LIKE 'op:%'),
kept AS (
  SELECT user_id, dimension, src, dst, relation FROM tagged t WHERE prim
   OR (relation = 'USES' AND EXISTS (SELECT 1 FROM sel s WHERE s.user_id = t.user_id AND s.dimension = t.dimension AND s.op = t.src))
   OR (relation = 'DIRECTLY_PRECEDES'
       AND EXISTS (SELECT 1 FROM sel s WHERE s.user_id = t.user_id AND s.dimension = t.dimension AND s.op = t.src)
       AND EXISTS (SELECT 1 FROM sel s WHERE s.user_id = t.user_id AND s.dimension = t.dimension AND s.op = t.dst)))"""


@query("projection_edges", f"""WITH {PROJECTION} SELECT user_id, dimension, src, dst, relation FROM kept""")
def projection_edges(spark, sf_dir):
    nodes, edges = graphs.sandbox_graph(long_log(spark, sf_dir), LONG)
    return graphs.project(nodes, edges, LONG)[1]


@query(
    "projection_nodes",
    f"""WITH {PROJECTION}
    SELECT DISTINCT user_id, dimension, node_id, label FROM (
      SELECT user_id, dimension, src AS node_id FROM kept UNION ALL SELECT user_id, dimension, dst FROM kept
      UNION ALL SELECT user_id, 'tool', node_id FROM snodes WHERE label LIKE 'op:%') JOIN snodes USING (user_id, node_id)""",
)
def projection_nodes(spark, sf_dir):
    nodes, edges = graphs.sandbox_graph(long_log(spark, sf_dir), LONG)
    return graphs.project(nodes, edges, LONG)[0]


@query(
    "temporal_chain",
    f"""WITH {S.SEGMENTS}, o AS (SELECT user_id, event_id, type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM log)
    SELECT user_id, 'event:' || p AS src, 'event:' || event_id AS dst, 'NEXT_OBSERVED' AS relation, type AS dst_type FROM o WHERE p IS NOT NULL""",
)
def temporal_chain(spark, sf_dir):
    return graphs.temporal_chain(long_log(spark, sf_dir), LONG)


SIGNATURES = f"""{S.TOOL_GRAPH},
sig AS (
  SELECT model, task_id, family, form, repeat,
    string_agg(r, chr(10) ORDER BY r) AS signature, count(*) FILTER (r LIKE 'n%') AS n_nodes, count(*) FILTER (r LIKE 'e%') AS n_edges
  FROM (SELECT model, task_id, family, form, repeat, 'n' || node_id || '#' || label AS r FROM nodes
        UNION ALL SELECT model, task_id, family, form, repeat, 'e' || src || '#' || dst || '#' || relation FROM edges)
  GROUP BY ALL)"""


@query(
    "graph_signature_stability",
    f"""WITH {SIGNATURES}
    SELECT model, task_id, family, form, count(*) AS n_runs, count(DISTINCT signature) AS n_signatures,
           count(DISTINCT signature) = 1 AS stable, sum(n_nodes)::BIGINT AS n_nodes, sum(n_edges)::BIGINT AS n_edges
    FROM sig GROUP BY ALL""",
)
def graph_signature_stability(spark, sf_dir):
    _, nodes, edges = tool_graph(spark, sf_dir)
    sig = graphs.signatures(nodes, edges, RUN_KEYS)
    return sig.groupBy("model", "task_id", "family", "form").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_distinct("signature").alias("n_signatures"),
        (F.count_distinct("signature") == 1).alias("stable"),
        F.sum("n_nodes").alias("n_nodes"),
        F.sum("n_edges").alias("n_edges"),
    )


@query(
    "wl_features",
    f"""WITH {S.TOOL_GRAPH}, {S.wl_features("model, task_id, family, form, repeat")}
    SELECT model, task_id, family, form, repeat, iteration, count(*) AS n_distinct, sum(cnt)::BIGINT AS n_features,
           sum(cnt * cnt)::BIGINT AS squared_norm FROM feat GROUP BY ALL""",
)
def wl_features(spark, sf_dir):
    """Size and norm of every feature bag; feature names are hashes and only identity matters."""
    _, nodes, edges = tool_graph(spark, sf_dir)
    bag = kernel.wl_features(nodes, edges, RUN_KEYS).groupBy(*RUN_KEYS, "iteration", "feature").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return bag.groupBy(*RUN_KEYS, "iteration").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("cnt").alias("n_features"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("squared_norm"),
    )


@query(
    "distinct_graphs",
    f"""WITH {SIGNATURES},
    shared AS (SELECT *, count(*) OVER (PARTITION BY signature) AS n_equal FROM sig)
    SELECT model, task_id, family, form, count(*) AS n_runs, count(DISTINCT signature) AS n_contents,
           sum(n_equal)::BIGINT AS n_equal, count(*) FILTER (n_equal = 1) AS n_alone FROM shared GROUP BY ALL""",
)
def distinct_graphs(spark, sf_dir):
    """How many graphs of the whole study share the content of a form's runs."""
    _, nodes, edges = tool_graph(spark, sf_dir)
    found = kernel.distinct_graphs(nodes, edges, RUN_KEYS)
    equal = found.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.count_if("stands").alias("standing"))
    one = F.when(F.col("standing") == 1, F.col("n")).otherwise(F.raise_error(F.lit("not one stands for all")))
    return found.join(equal.select("g1", "g2", one.alias("n")), ["g1", "g2"]).groupBy("model", "task_id", "family", "form").agg(
        F.count("*").alias("n_runs"),
        F.count_distinct("g1", "g2").alias("n_contents"),
        F.sum("n").alias("n_equal"),
        F.count_if(F.col("n") == 1).alias("n_alone"),
    )


@query(
    "wl_similarity_pairs",
    f"""WITH {S.PAIRS} SELECT model, task_id, family, form, comparison, left_repeat, right_repeat, round(similarity, 9) AS similarity FROM pairs""",
)
def wl_similarity_pairs(spark, sf_dir):
    return run_pairs(spark, sf_dir)


FOOTPRINT = (
    S.TOOL_GRAPH
    + ","
    + S.RUNS
    + ","
    + S.wl_features("model, task_id, family, form, repeat", suffix="_t")
    + ","
    + S.pair_similarity("model, task_id", feat="feat_t", suffix="_t")
    + ","
    + S.wl_features(
        "model, task_id, family, form, repeat", suffix="_f", cond="relation <> 'DIRECTLY_PRECEDES'"
    )
    + ","
    + S.pair_similarity("model, task_id", feat="feat_f", suffix="_f")
)


@query(
    "footprint_vs_trajectory",
    f"""WITH {FOOTPRINT}
    SELECT model, task_id, family, form, comparison, left_repeat, right_repeat,
           round(f.similarity, 9) AS footprint_similarity, round(t.similarity, 9) AS trajectory_similarity
    FROM pairs_f f JOIN pairs_t t USING (model, task_id, family, form, comparison, left_repeat, right_repeat)""",
)
def footprint_vs_trajectory(spark, sf_dir):
    """Order-free and order-aware similarity: two views of each graph, labelled by one run of the kernel."""
    base, nodes, edges = tool_graph(spark, sf_dir)
    names = ("trajectory_similarity", "footprint_similarity")
    shared = kernel.packed_features(
        nodes.withColumn("views", F.lit(3)),
        edges.withColumn("views", F.when(F.col("relation") == graphs.PRECEDES, 1).otherwise(3)),
        RUN_KEYS,
        names,
    )
    pairs = kernel.packed_pair_scores(*shared, base.select(*RUN_KEYS), TASK_KEYS, names)
    return pairs.select(
        *TASK_KEYS, "family", "form", "comparison", "left_repeat", "right_repeat", "footprint_similarity", "trajectory_similarity"
    )


SANDBOX_RUN_EDGES = S.SANDBOX_EDGES.replace("PARTITION BY user_id", "PARTITION BY rid").replace("user_id", "rid").replace(
    "rid % 3", "user_id % 3").replace("(rid // 3)", "(user_id // 3)").replace("lpad(rid::", "lpad(user_id::").replace(
    "d % 3 AS repeat, rid,", "d % 3 AS repeat, user_id * 100 + d AS rid,").replace(
    "SELECT event_id, rid, event_type", "SELECT event_id, user_id, event_type")
DIM_PROJECTION = PROJECTION.replace(S.SANDBOX_EDGES, "").replace("user_id", "rid")


@query(
    "behavioral_similarity",
    f"""WITH {SANDBOX_RUN_EDGES}{DIM_PROJECTION},
    ids AS (SELECT DISTINCT rid, model, task_id, family, form, repeat FROM base),
    pnodes AS (SELECT DISTINCT rid, dimension, node_id, label FROM (
      SELECT rid, dimension, src AS node_id FROM kept UNION ALL SELECT rid, dimension, dst FROM kept
      UNION ALL SELECT rid, 'tool', node_id FROM snodes WHERE label LIKE 'op:%') JOIN snodes USING (rid, node_id)),
    runs AS (SELECT model, task_id, dimension, family, form, repeat FROM ids, (SELECT unnest(['permission','information','tool']) AS dimension)),
    gn AS (SELECT model, task_id, dimension, family, form, repeat, node_id, label FROM pnodes JOIN ids USING (rid)),
    ge AS (SELECT model, task_id, dimension, family, form, repeat, src, dst, relation FROM kept JOIN ids USING (rid)),
    {S.wl_features("model, task_id, dimension, family, form, repeat", nodes="gn", edges="ge")},
    {S.pair_similarity("model, task_id, dimension")}
    SELECT model, task_id, dimension, family, form, comparison, count(*) AS n_pairs, round(avg(similarity), 9) AS similarity
    FROM pairs GROUP BY ALL""",
)
def behavioral_similarity(spark, sf_dir):
    base = stored_runs(spark, sf_dir)
    nodes, edges = graphs.sandbox_graph(sandbox_log(base), RUN_KEYS)
    pn, pe = graphs.project_views(nodes, edges, RUN_KEYS)
    task = [*TASK_KEYS, "dimension"]
    shared = kernel.view_features(pn, pe, RUN_KEYS, graphs.DIMENSIONS, "dimension")
    vectors = kernel.shared_vectors(*shared, [*task, "family", "form"])
    dims = F.array(*[F.lit(d) for d in graphs.DIMENSIONS])
    runs = base.select(*RUN_KEYS).withColumn("dimension", F.explode(dims))
    return (
        kernel.pair_scores(vectors, runs, task)
        .groupBy(*task, "family", "form", "comparison")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("similarity").alias("similarity"))
    )


VARIANT_COLUMNS = ", ".join(
    f"round({p}_{s}, 9) AS {p}_{s}"
    for p in ("source_variant", "variant_internal", "source_internal")
    for s in ("mean", "min", "max")
)


@query(
    "variant_scores",
    f"""WITH {S.VARIANTS} SELECT model, task_id, family, form, n_source_variant_pairs, {VARIANT_COLUMNS},
    round(delta_baseline_minus_variant, 9) AS delta_baseline_minus_variant FROM variants""",
)
def variant_scores(spark, sf_dir):
    return variants(spark, sf_dir)


SCORES = ("source_internal_mean", "source_variant_mean", "variant_internal_mean", "delta_baseline_minus_variant")


@query(
    "task_family_scores",
    f"""WITH {S.TASK_FAMILY} SELECT subset, model, task_id, family, variant_count,
    {", ".join(f"round({c}, 9) AS {c}" for c in SCORES)} FROM task_family""",
)
def task_family_scores(spark, sf_dir):
    return task_family(spark, sf_dir)


@query(
    "similarity_summary_long",
    f"""WITH {S.TASK_FAMILY}
    SELECT subset, {S.DATASET} AS dataset, model, family, count(*) AS n_tasks,
      round(avg(source_internal_mean), 9) AS baseline, round(avg(source_variant_mean), 9) AS source_variant,
      round(avg(variant_internal_mean), 9) AS variant_internal,
      round(avg(delta_baseline_minus_variant), 9) AS delta_baseline_minus_variant
    FROM task_family GROUP BY ALL""",
)
def similarity_summary_long(spark, sf_dir):
    return summaries.summary_long(task_family(spark, sf_dir))


@query(
    "similarity_summary_wide",
    f"""WITH {S.TASK_FAMILY},
    bt AS (SELECT model, task_id, avg(similarity) AS b FROM pairs WHERE comparison = 'source_internal' GROUP BY ALL),
    b AS (SELECT {S.DATASET} AS dataset, model, avg(b) AS baseline, count(*) AS baseline_tasks FROM bt GROUP BY ALL),
    w AS (SELECT subset, {S.DATASET} AS dataset, model,
      {", ".join(f"avg(source_variant_mean) FILTER (family = '{f}') AS {f}_source_variant" for f in summaries.FAMILIES)},
      {", ".join(f"avg(delta_baseline_minus_variant) FILTER (family = '{f}') AS {f}_delta" for f in summaries.FAMILIES)},
      {", ".join(f"count(*) FILTER (family = '{f}') AS {f}_tasks" for f in summaries.FAMILIES)}
      FROM task_family GROUP BY ALL)
    SELECT dataset, model, subset, round(baseline, 9) AS baseline, baseline_tasks,
      {", ".join(f"round({f}_source_variant, 9) AS {f}_source_variant, round({f}_delta, 9) AS {f}_delta, {f}_tasks" for f in summaries.FAMILIES)}
    FROM w LEFT JOIN b USING (dataset, model)""",
)
def similarity_summary_wide(spark, sf_dir):
    pairs = run_pairs(spark, sf_dir)
    v = summaries.variant_scores(pairs, TASK_KEYS).withColumn(
        "strict_mt_eligible", ~F.col("form").isin(*NOT_STRICT)
    )
    tf = summaries.task_family_scores(summaries.with_subsets(v), TASK_KEYS)
    return summaries.summary_wide(tf, summaries.baseline_scores(pairs, TASK_KEYS))


@query(
    "boxplot_stats",
    f"""WITH {S.TASK_FAMILY},
    x AS (SELECT {S.DATASET} AS dataset, model, family, source_variant_mean AS v FROM task_family WHERE subset = 'all'),
    q AS (SELECT dataset, model, family, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
           quantile_cont(v, 0.75) AS q3 FROM x GROUP BY ALL)
    SELECT dataset, model, family, n, round(mean, 9) AS mean, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
      round((SELECT min(v) FROM x WHERE x.dataset = q.dataset AND x.model = q.model AND x.family = q.family AND v >= q1 - 1.5 * (q3 - q1)), 9) AS whisker_low,
      round((SELECT max(v) FROM x WHERE x.dataset = q.dataset AND x.model = q.model AND x.family = q.family AND v <= q3 + 1.5 * (q3 - q1)), 9) AS whisker_high
    FROM q""",
)
def boxplot_stats(spark, sf_dir):
    from agentrace.operators.logs import dataset_name

    tf = task_family(spark, sf_dir).filter(F.col("subset") == "all")
    v = tf.select(dataset_name(F.col("task_id")).alias("dataset"), "model", "family", "source_variant_mean")
    return summaries.boxplot_stats(v, ["dataset", "model", "family"], "source_variant_mean")


@query(
    "histogram_bins",
    f"""WITH {S.VARIANTS}, h AS (SELECT family, least(floor(source_variant_mean * 20), 19)::INTEGER AS bin, count(*) AS n FROM variants GROUP BY ALL)
    SELECT family, bin, n, round(n / sum(n) OVER (PARTITION BY family), 9) AS share FROM h""",
)
def histogram_bins(spark, sf_dir):
    return summaries.histogram(variants(spark, sf_dir), ["family"], "source_variant_mean")
