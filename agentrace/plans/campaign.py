"""Queries over campaigns: samples, trials, attempts, pass rates, cost, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.operators import campaign as CA
from agentrace.operators import coding as CD
from agentrace.operators import stats
from agentrace.operators.logs import dataset_name
from agentrace.plans import consequences as CQ
from agentrace.plans import fixture_sql as S
from agentrace.plans.registry import query
from agentrace.sources.tables import results, runs_base, table

TASKS = f"{S.BASE}, tasks AS (SELECT DISTINCT task_id, {S.DATASET} AS dataset FROM base)"


def tasks_table(spark, sf_dir):
    return runs_base(spark, sf_dir).select("task_id").distinct().withColumn("dataset", dataset_name(F.col("task_id")))


@query(
    "hash_sample_global",
    f"WITH {TASKS} SELECT task_id, sha256('global:' || task_id) AS hash_key FROM tasks ORDER BY 2 LIMIT 15",
)
def hash_sample_global(spark, sf_dir):
    return stats.hash_sample(tasks_table(spark, sf_dir), "task_id", "global:", 15).select("task_id", "hash_key")


@query(
    "hash_sample_stratified",
    f"WITH {TASKS} SELECT dataset, task_id, row_number() OVER (PARTITION BY dataset ORDER BY sha256('subset:' || task_id)) AS hash_rank FROM tasks QUALIFY hash_rank <= 10",
)
def hash_sample_stratified(spark, sf_dir):
    picked = stats.hash_sample_per_stratum(tasks_table(spark, sf_dir), "dataset", "task_id", "subset:", 10)
    return picked.select("dataset", "task_id", "hash_rank")


@query(
    "subset_restriction",
    f"""WITH {TASKS}, pick AS (SELECT task_id FROM tasks QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sha256('subset:' || task_id)) <= 10)
    SELECT task_id, form, count(DISTINCT repeat) AS runs FROM base WHERE task_id IN (SELECT task_id FROM pick) AND form IN ('source','p01','n01','i01','lang_zh','lang_fr','formulation') GROUP BY ALL""",
)
def subset_restriction(spark, sf_dir):
    base = runs_base(spark, sf_dir)
    subset = stats.hash_sample_per_stratum(tasks_table(spark, sf_dir), "dataset", "task_id", "subset:", 10)
    return (
        base.filter(F.col("form").isin("source", "p01", "n01", "i01", "lang_zh", "lang_fr", "formulation"))
        .join(subset.select("task_id"), "task_id", "left_semi")
        .groupBy("task_id", "form")
        .agg(F.count_distinct("repeat").alias("runs"))
    )


@query(
    "task_pool_eligibility",
    """SELECT p_partkey AS task, p_size AS minutes FROM part WHERE p_size % 3 <> 0 AND coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size END, 0) <= 40
    AND coalesce(p_retailprice, 0) <= 1500 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R')""",
)
def task_pool_eligibility(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task"),
        F.when(F.col("p_size") % 3 == 0, "hard").otherwise("easy").alias("difficulty"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("expert_minutes"),
        F.col("p_retailprice").alias("timeout_seconds"),
        F.col("p_size").alias("minutes"),
    )
    excluded = table(spark, sf_dir, "lineitem").filter(
        (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    ).select(F.col("l_partkey").alias("task"))
    return CA.eligible_tasks(pool, excluded, max_minutes=40, max_timeout=1500).select("task", "minutes")


TRIALS = """trials AS (SELECT o_orderkey AS trial, 'agent_' || (o_custkey % 2) AS agent,
  'agent_' || (o_custkey % 2) || CASE WHEN o_orderkey % 17 = 0 THEN '_smoke' ELSE '_full' END AS job,
  't' || (o_custkey % 37) || '__' || CASE o_custkey % 4 WHEN 0 THEN 'source__source' WHEN 1 THEN 'tone__p01' WHEN 2 THEN 'multilingual__lang_zh' ELSE 'formulation__f' END AS task_form,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'running' WHEN o_orderstatus <> 'F' THEN 'ok'
    WHEN o_orderkey % 4 = 0 THEN 'infra' WHEN o_orderkey % 4 = 1 AND o_orderkey % 5 = 0 THEN 'infra' ELSE 'agent' END AS outcome,
  CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 10) / 10 END AS reward FROM orders)"""


def trials_table(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    variant = (
        F.when(cust % 4 == 0, "source__source")
        .when(cust % 4 == 1, "tone__p01")
        .when(cust % 4 == 2, "multilingual__lang_zh")
        .otherwise("formulation__f")
    )
    failed = F.col("o_orderstatus") == "F"
    agent = F.concat(F.lit("agent_"), (cust % 2).cast("string"))
    return o.select(
        key.alias("trial"),
        agent.alias("agent"),
        F.concat(agent, F.when(key % 17 == 0, "_smoke").otherwise("_full")).alias("job"),
        F.concat(F.lit("tasks/t"), (cust % 37).cast("string"), F.lit("__"), variant, F.lit("/")).alias("path"),
        (~((F.col("o_orderstatus") == "P") & (key % 3 == 0))).alias("has_result"),
        F.when(
            failed,
            F.when(key % 4 == 0, "NetworkConnectionError")
            .when(key % 4 == 1, "NonZeroAgentExitCodeError")
            .otherwise("AgentTimeoutError"),
        ).alias("exception_type"),
        F.when(failed & (key % 5 == 0), "apt-get install failed").alias("exception_message"),
        F.when(key % 6 != 0, (key % 10) / 10).alias("reward"),
    )


@query("trial_classification", f"WITH {TRIALS} SELECT agent, task_form, outcome, count(*) AS n FROM trials GROUP BY ALL")
def trial_classification(spark, sf_dir):
    t = trials_table(spark, sf_dir)
    return t.groupBy("agent", CD.task_form(F.col("path")).alias("task_form"), CD.trial_class().alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


COUNTED = f"""{TRIALS}, counted AS (SELECT * FROM trials WHERE outcome IN ('ok','agent') AND job NOT LIKE '%smoke%'
  QUALIFY row_number() OVER (PARTITION BY agent, task_form ORDER BY trial) <= 3)"""


@query(
    "first_three_trials",
    f"WITH {COUNTED} SELECT agent, task_form, trial, row_number() OVER (PARTITION BY agent, task_form ORDER BY trial) AS ordinal FROM counted",
)
def first_three_trials(spark, sf_dir):
    return CD.counted_trials(trials_table(spark, sf_dir)).select("agent", "task_form", "trial", "ordinal")


@query(
    "attempts_needed",
    f"""WITH {TRIALS}, forms AS (SELECT DISTINCT agent, task_form FROM trials), v AS (SELECT agent, task_form, count(*) AS n FROM trials WHERE outcome IN ('ok','agent') GROUP BY ALL)
    SELECT agent, task_form, 120 - coalesce(n, 0) AS need FROM forms LEFT JOIN v USING (agent, task_form) WHERE coalesce(n, 0) < 120""",
)
def attempts_needed(spark, sf_dir):
    t = trials_table(spark, sf_dir)
    forms = t.select("agent", CD.task_form(F.col("path")).alias("task_form")).distinct()
    return CD.attempts_needed(t, forms, wanted=120)


@query(
    "pass_rate",
    f"""WITH {COUNTED}, f AS (SELECT agent, split_part(task_form, '__', 1) AS task, split_part(task_form, '__', 2) AS family, task_form, avg(coalesce(reward, 0.0)) AS r FROM counted GROUP BY ALL),
    t AS (SELECT agent, task, family, avg(r) AS r FROM f GROUP BY ALL) SELECT agent, family, count(*) AS n_tasks, round(avg(r), 9) AS pass_rate FROM t GROUP BY ALL""",
)
def pass_rate(spark, sf_dir):
    return CD.pass_rates(CD.counted_trials(trials_table(spark, sf_dir)))


@query(
    "token_cost",
    f"""WITH {S.BASE}, u AS (SELECT model, task_id, family, form, repeat, event_id, 100 + k AS i, k AS c, 2 * k AS o FROM base)
    SELECT model, family, count(DISTINCT (task_id, form, repeat)) AS n_runs, sum(i)::BIGINT AS input_tokens, sum(c)::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens,
      round(sum((i - c) * 0.4 + c * 0.1 + o * 1.6) / 1e6, 9) AS cost FROM u GROUP BY ALL""",
)
def token_cost(spark, sf_dir):
    k = F.col("k").cast("long")
    calls = runs_base(spark, sf_dir).select(
        "model", "task_id", "family", "form", "repeat",
        F.array(F.struct((k + 100).alias("input_tokens"), k.alias("cached_tokens"), (2 * k).alias("output_tokens"))).alias("usage"),
    )
    return CA.token_cost(calls, ["model", "family"])


@query(
    "budget_stop",
    f"""WITH {S.BASE}, c AS (SELECT model, event_id, (100.0 - 0.0) * 0.4 + k * 3.3 AS cost FROM base),
    r AS (SELECT *, sum(cost) OVER (PARTITION BY model ORDER BY event_id) AS running_cost FROM c)
    SELECT model, count(*) AS n_within, max(event_id) AS last_event FROM r WHERE running_cost - cost < 20000 GROUP BY ALL""",
)
def budget_stop(spark, sf_dir):
    k = F.col("k")
    cost = runs_base(spark, sf_dir).select("model", "event_id", (F.lit(40.0) + k * 3.3).alias("cost"))
    kept = CA.within_budget(cost, ["model"], "event_id", "cost", 20000.0)
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n_within"), F.max("event_id").alias("last_event"))


@query(
    "extraction_convergence",
    f"""WITH {S.BASE}, {CQ.RES}, {TASKS.split(S.BASE + ",", 1)[1]}, x AS (SELECT task_id || '#' || repeat AS task_id, dataset, family, form, ' ' || final_response AS extracted FROM res JOIN tasks USING (task_id)),
    s AS (SELECT task_id, trim(extracted) AS src FROM x WHERE form = 'source')
    SELECT dataset, family, round(avg((trim(extracted) = src)::INTEGER), 9) AS identical_to_source, count(*) AS n FROM x JOIN s USING (task_id) WHERE form <> 'source' GROUP BY ALL""",
)
def extraction_convergence(spark, sf_dir):
    extracted = results(runs_base(spark, sf_dir)).select(
        F.concat_ws("#", "task_id", "repeat").alias("task_id"),
        dataset_name(F.col("task_id")).alias("dataset"),
        "family",
        "form",
        F.concat(F.lit(" "), F.col("final_response")).alias("extracted"),
    )
    return CA.extraction_convergence(extracted)


@query(
    "condition_comparison",
    f"""WITH {S.BASE}, {CQ.RES}, c AS (SELECT {S.DATASET} AS dataset, family, task_id, CASE WHEN model = 'model_0' THEN 'none' ELSE 'treated' END AS condition, (status = 'turn_budget')::INTEGER AS v FROM ok),
    t AS (SELECT dataset, family, condition, task_id, avg(v) AS v FROM c GROUP BY ALL), g AS (SELECT dataset, family, condition, avg(v) AS v, count(*) AS n FROM t GROUP BY ALL)
    SELECT dataset, family, round(max(v) FILTER (condition = 'none'), 9) AS value_none, round(max(v) FILTER (condition = 'treated'), 9) AS value_treated,
      round(max(v) FILTER (condition = 'treated') - max(v) FILTER (condition = 'none'), 9) AS change, max(n) FILTER (condition = 'none') AS tasks_none, max(n) FILTER (condition = 'treated') AS tasks_treated FROM g GROUP BY ALL""",
)
def condition_comparison(spark, sf_dir):
    runs = CQ.usable(runs_base(spark, sf_dir)).select(
        dataset_name(F.col("task_id")).alias("dataset"),
        "family",
        "task_id",
        F.when(F.col("model") == "model_0", "none").otherwise("treated").alias("condition"),
        (F.col("status") == "turn_budget").cast("int").alias("v"),
    )
    return CA.compare_conditions(runs, ["dataset", "family"], "v", ("none", "treated"))


STEPS = f"""{S.BASE}, cl AS (SELECT model, task_id, family, form, repeat, event_id, event_type, k, value,
  CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'WebFetch' ELSE 'My-Tool' END AS fn FROM base)"""


def steps_table(base: DataFrame) -> DataFrame:
    """Trajectory steps: one agent step per event with one or two tool calls, or a closing text."""
    k = F.col("k")
    text = lambda c: c.cast("string")
    command = F.concat(
        F.lit("cd /app && sudo FOO=1 python3 -m pip install x; sed -i 's/a;b/c/' src/f"),
        text(k % 4),
        F.lit(".py | grep \"two words\" notes.txt\n/usr/bin/git status"),
    )
    args = (
        F.when(
            (F.col("event_type") == "click") & (k % 2 == 1),
            F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), command).alias("command"))),
        )
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("").alias("command"), command.alias("cmd"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.concat(F.lit("/data/a"), text(k % 3), F.lit(".csv")).alias("file_path"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("").alias("path"), F.concat(F.lit("*** Update File: b"), text(k % 3), F.lit(".py\n*** Add File: c.py")).alias("patch"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.concat(F.lit("https://h"), text(k % 3), F.lit(".org/x/y")).alias("url"))))
        .otherwise(F.lit("{}"))
    )
    fn = (
        F.when(F.col("event_type") == "click", "Bash")
        .when(F.col("event_type") == "view", "Read")
        .when(F.col("event_type") == "purchase", "Edit")
        .when(F.col("event_type") == "signup", "WebFetch")
        .otherwise("My-Tool")
    )
    call_id = F.concat(F.lit("c"), text(F.col("event_id")))
    call = F.struct(fn.alias("function_name"), args.alias("arguments"), call_id.alias("tool_call_id"))
    plan = F.struct(F.lit("TodoWrite").alias("function_name"), F.lit("{}").alias("arguments"), F.lit("p").alias("tool_call_id"))
    silent = (F.col("event_type") == "error") & (k % 2 == 0)
    none = F.array().cast("array<struct<function_name:string,arguments:string,tool_call_id:string>>")
    return base.select(
        *CQ.KEYS,
        F.col("event_id").alias("step"),
        F.lit("agent").alias("source"),
        F.when(silent, F.concat(F.lit("done "), text(k))).alias("message"),
        F.when(silent, none).when(k % 5 == 0, F.array(call, plan)).otherwise(F.array(call)).alias("tool_calls"),
        F.struct(
            F.array(
                F.struct(
                    call_id.alias("source_call_id"),
                    F.when(F.col("value") > 100, "Traceback (most recent call last)").otherwise("fine").alias("content"),
                )
            ).alias("results")
        ).alias("observation"),
    )


CODING = f"""{STEPS},
raw AS (
  SELECT {CQ.K}, 'read_file' AS kind, 'file' AS tool, '/data/a' || (k % 3) || '.csv' AS paths, value, k FROM cl WHERE event_type = 'view'
  UNION ALL SELECT {CQ.K}, 'write_file', 'file', 'b' || (k % 3) || '.py|c.py', value, k FROM cl WHERE event_type = 'purchase'
  UNION ALL SELECT {CQ.K}, 'network', 'web', 'h' || (k % 3) || '.org', value, k FROM cl WHERE event_type = 'signup'
  UNION ALL SELECT {CQ.K}, 'other', 'my_tool', '', value, k FROM cl WHERE event_type = 'error' AND k % 2 = 1)"""


OPS = f"""{STEPS},
shell AS (SELECT unnest([
  {{'i': 0, 'kind': 'install', 'program': 'python3', 'paths': ''}}, {{'i': 1, 'kind': 'write', 'program': 'sed', 'paths': 's/a'}},
  {{'i': 2, 'kind': 'build_run', 'program': chr(39), 'paths': 'src/f#.py'}}, {{'i': 3, 'kind': 'read', 'program': 'grep', 'paths': 'notes.txt'}},
  {{'i': 4, 'kind': 'vcs', 'program': 'git', 'paths': ''}}]) AS s),
op AS (
  SELECT {CQ.K}, event_id, s.i AS i, s.kind AS kind, 'shell' AS tool, s.program AS program, replace(s.paths, '#', (k % 4)::VARCHAR) AS paths, value FROM cl, shell WHERE event_type = 'click'
  UNION ALL SELECT {CQ.K}, event_id, 0, 'read_file', 'file', NULL, '/data/a' || (k % 3) || '.csv', value FROM cl WHERE event_type = 'view'
  UNION ALL SELECT {CQ.K}, event_id, 0, 'write_file', 'file', NULL, 'b' || (k % 3) || '.py|c.py', value FROM cl WHERE event_type = 'purchase'
  UNION ALL SELECT {CQ.K}, event_id, 0, 'network', 'web', NULL, 'h' || (k % 3) || '.org', value FROM cl WHERE event_type = 'signup'
  UNION ALL SELECT {CQ.K}, event_id, 0, 'other', 'my_tool', NULL, '', value FROM cl WHERE event_type = 'error' AND k % 2 = 1
  UNION ALL SELECT {CQ.K}, event_id, 9, 'plan', 'plan', NULL, '', 0 FROM cl WHERE k % 5 = 0 AND NOT (event_type = 'error' AND k % 2 = 0))"""


@query(
    "coding_ops",
    f"""WITH {OPS} SELECT {CQ.K}, row_number() OVER (PARTITION BY {CQ.K} ORDER BY event_id, i) - 1 AS op_ord, kind, tool,
      CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS outcome, program, paths FROM op""",
)
def coding_ops(spark, sf_dir):
    calls = CD.step_calls(steps_table(runs_base(spark, sf_dir)), CQ.KEYS)
    ops = CD.call_operations(calls, CQ.KEYS)
    return ops.withColumn("paths", F.array_join("paths", "|"))


@query(
    "coding_file_ops",
    f"""WITH {CODING} SELECT {CQ.K}, kind, tool, paths, CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS outcome, count(*) AS n FROM raw GROUP BY ALL""",
)
def coding_file_ops(spark, sf_dir):
    calls = CD.step_calls(steps_table(runs_base(spark, sf_dir)), CQ.KEYS)
    ops = CD.call_operations(calls, CQ.KEYS).filter(~F.col("tool").isin("shell", "plan"))
    return ops.groupBy(*CQ.KEYS, "kind", "tool", F.array_join("paths", "|").alias("paths"), "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "coding_graph_edges",
    f"""WITH {OPS}, n AS (SELECT *, row_number() OVER (PARTITION BY {CQ.K} ORDER BY event_id, i) - 1 AS op_ord FROM op)
    SELECT {CQ.K}, 'op:' || op_ord AS src, 'tool:' || {S.slug("tool")} AS dst, 'USES' AS relation FROM n
    UNION ALL SELECT {CQ.K}, 'op:' || op_ord, 'argument:' || {S.slug("'program=' || program")}, 'HAS_ARGUMENT' FROM n WHERE program IS NOT NULL
    UNION ALL SELECT {CQ.K}, 'op:' || (op_ord - 1), 'op:' || op_ord, 'DIRECTLY_PRECEDES' FROM n WHERE op_ord > 0
    UNION ALL SELECT {CQ.K}, 'op:' || op_ord, CASE WHEN kind = 'network' THEN 'recipient:' ELSE 'resource:' END || {S.slug("p")},
      CASE WHEN kind IN ('read', 'read_file', 'search') THEN 'READS' WHEN kind IN ('write', 'write_file') THEN 'CHANGES_STATE'
           WHEN kind = 'network' THEN 'DISCLOSES_TO' ELSE 'ACCESSES' END
      FROM (SELECT *, unnest(string_split(paths, '|')) AS p FROM n WHERE paths <> '')""",
)
def coding_graph_edges(spark, sf_dir):
    calls = CD.step_calls(steps_table(runs_base(spark, sf_dir)), CQ.KEYS)
    return CD.coding_graph(CD.call_operations(calls, CQ.KEYS), CQ.KEYS)[1]


@query(
    "final_messages",
    f"""WITH {STEPS} SELECT {CQ.K}, coalesce(arg_max('done ' || k, event_id) FILTER (event_type = 'error' AND k % 2 = 0), '') AS final_message FROM cl GROUP BY ALL""",
)
def final_messages(spark, sf_dir):
    return CD.final_messages(steps_table(runs_base(spark, sf_dir)), CQ.KEYS)


@query(
    "episode_counters",
    f"""WITH {S.BASE} SELECT {CQ.K}, count(*) AS invocations, count(*) FILTER (NOT value > 150 AND k % 10 <> 9) AS responses, count(*) FILTER (value > 150) AS coverage_gaps,
     count(*) FILTER (value > 150) > 0 AS censored FROM base GROUP BY ALL""",
)
def episode_counters(spark, sf_dir):
    from agentrace.sources.tables import tool_log

    return CA.episode_counters(tool_log(runs_base(spark, sf_dir)), CQ.KEYS)


@query(
    "short_form_jobs",
    f"""WITH {COUNTED}, n AS (SELECT agent, task_form, count(*) AS n FROM counted GROUP BY ALL)
    SELECT agent, task_form, n, CASE WHEN n < 3 THEN agent || '|' || split_part(task_form, '__', 1) || '|short_' || split_part(task_form, '__', 3) ELSE agent || '|' || split_part(task_form, '__', 1) END AS job_id,
      n * (n - 1) // 2 AS internal_pairs FROM n""",
)
def short_form_jobs(spark, sf_dir):
    n = CD.counted_trials(trials_table(spark, sf_dir)).groupBy("agent", "task_form").agg(F.count(F.lit(1)).alias("n"))
    return CA.short_form_jobs(n)
