"""Queries over judged outputs: jobs, packing, validation, score means, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.operators import judging as J
from agentrace.operators import stats, summaries
from agentrace.operators.logs import dataset_name
from agentrace.operators.ordered import running
from agentrace.plans import consequences as CQ
from agentrace.plans import fixture_sql as S
from agentrace.plans.registry import query
from agentrace.plans.similarity import TASK_KEYS as TASK_TUPLE
from agentrace.plans.similarity import variants
from agentrace.session import materialize
from agentrace.sources.tables import RUN_KEYS, results, runs_base, sandbox_log, stored_runs

BUDGET = J.MAX_PROMPT_CHARS
TASK_KEYS = list(TASK_TUPLE)
FORM_KEYS = ["model", "task_id", "family", "form"]

OUTPUTS = f"""{S.BASE}, {CQ.RES},
outs AS (SELECT model, task_id, family, form, count(*) AS n_runs, count(*) = 3 AS complete,
  [max(final_response) FILTER (repeat = 0), max(final_response) FILTER (repeat = 1), max(final_response) FILTER (repeat = 2)] AS outputs,
  [max(sum_k) FILTER (repeat = 0), max(sum_k) FILTER (repeat = 1), max(sum_k) FILTER (repeat = 2)] AS ks
  FROM res GROUP BY ALL),
src AS (SELECT model, task_id, outputs AS source_outputs, ks AS source_ks FROM outs WHERE family = 'source' AND complete),
jv AS (SELECT o.model, o.task_id, o.family, o.form, o.outputs, s.source_outputs, o.ks, s.source_ks,
  {J.HEADER_CHARS} + length('Do ' || o.task_id) + list_sum([length(x) for x in s.source_outputs]) + {J.OUTPUT_CHARS * 3 + 2} AS header_chars,
  {J.VARIANT_CHARS} + length(o.form) + list_sum([length(x) for x in o.outputs]) + {J.OUTPUT_CHARS * 3 + 2} AS variant_chars
  FROM outs o JOIN src s USING (model, task_id) WHERE o.family <> 'source' AND o.complete)"""


#: How often the responses of a task are repeated to make long ones.
LONG_SQL = "200 + 60 * (ascii(right(task_id, 1)) - 48)"


def prompts(base: DataFrame) -> DataFrame:
    return base.select("task_id").distinct().withColumn("prompt", F.concat(F.lit("Do "), F.col("task_id")))


def outputs_table(base: DataFrame) -> DataFrame:
    return J.three_outputs(results(base), FORM_KEYS)


def variant_table(base: DataFrame) -> DataFrame:
    return J.job_variants(outputs_table(base), prompts(base))


@query(
    "three_run_outputs",
    f"WITH {OUTPUTS} SELECT model, task_id, family, form, n_runs, complete, array_to_string(list_filter(outputs, lambda x: x IS NOT NULL), '|') AS outputs FROM outs",
)
def three_run_outputs(spark, sf_dir):
    out = outputs_table(runs_base(spark, sf_dir))
    return out.withColumn("outputs", F.array_join("outputs", "|"))


def packing_sql(outputs: str) -> str:
    return f"""WITH RECURSIVE {outputs},
    ord AS (SELECT *, row_number() OVER (PARTITION BY model, task_id, family ORDER BY form) AS rn, max(header_chars) OVER (PARTITION BY model, task_id, family) + {J.FOOTER_CHARS} AS fixed FROM jv),
    pk AS (SELECT model, task_id, family, form, rn, 0 AS chunk, variant_chars + 1 AS used FROM ord WHERE rn = 1
      UNION ALL SELECT o.model, o.task_id, o.family, o.form, o.rn,
        CASE WHEN o.fixed + p.used + o.variant_chars + 1 > {BUDGET} THEN p.chunk + 1 ELSE p.chunk END,
        CASE WHEN o.fixed + p.used + o.variant_chars + 1 > {BUDGET} THEN o.variant_chars + 1 ELSE p.used + o.variant_chars + 1 END
      FROM ord o JOIN pk p ON o.model = p.model AND o.task_id = p.task_id AND o.family = p.family AND o.rn = p.rn + 1),
    n AS (SELECT *, max(chunk) OVER (PARTITION BY model, task_id, family) + 1 AS chunk_count FROM pk)
    SELECT model, task_id, family, form, chunk, chunk_count, model || '|' || task_id || '|' || family || CASE WHEN chunk_count > 1 THEN '|chunk' || lpad(chunk::VARCHAR, 2, '0') ELSE '' END AS job_id FROM n"""


@query("judge_job_packing", packing_sql(OUTPUTS))
def judge_job_packing(spark, sf_dir):
    return J.pack_jobs(variant_table(runs_base(spark, sf_dir)), BUDGET)


LONG_OUTPUTS = OUTPUTS.replace(
    "outs AS (", f"longer AS (SELECT * REPLACE (repeat(final_response, {LONG_SQL}) AS final_response) FROM res),\nouts AS ("
).replace("FROM res GROUP BY ALL", "FROM longer GROUP BY ALL")


@query("judge_job_packing_long", packing_sql(LONG_OUTPUTS))
def judge_job_packing_long(spark, sf_dir):
    """Responses of some thousand characters, so that a family's variants fill several prompts."""
    base = runs_base(spark, sf_dir)
    last = F.ascii(F.right("task_id", F.lit(1))) - 48
    longer = results(base).withColumn("final_response", F.repeat("final_response", 200 + 60 * last))
    variants = J.job_variants(J.three_outputs(longer, FORM_KEYS), prompts(base))
    return J.pack_jobs(variants, BUDGET)


@query(
    "prompt_cost",
    f"""WITH {OUTPUTS}, j AS (SELECT model, task_id, family, max(header_chars) + sum(variant_chars + 1) + {J.FOOTER_CHARS} AS chars FROM jv GROUP BY ALL)
    SELECT model, family, count(*) AS jobs, sum(chars)::BIGINT AS chars, round(sum(chars) / 4, 9) AS tokens, round(sum(chars) / 4 * 2.5 / 1e6, 9) AS cost FROM j GROUP BY ALL""",
)
def prompt_cost(spark, sf_dir):
    return J.prompt_cost(variant_table(runs_base(spark, sf_dir)), 2.5)


def judged_variants(base: DataFrame) -> DataFrame:
    """Variants with judge scores 0–4 derived from the two runs of each pair."""
    done = materialize(results(base), "results")
    ks = done.groupBy(*FORM_KEYS).agg(
        F.array(*[F.max(F.when(F.col("repeat") == r, F.col("sum_k"))) for r in range(3)]).alias("ks")
    )
    source = ks.filter(F.col("family") == "source").select("model", "task_id", F.col("ks").alias("source_ks"))
    score = lambda a, i, b, j: F.pmod(F.col(a)[i] + F.col(b)[j], F.lit(5)).cast("int")
    return (
        J.job_variants(J.three_outputs(done, FORM_KEYS), prompts(done))
        .join(ks, FORM_KEYS)
        .join(source, TASK_KEYS)
        .withColumns(
            {
                "sv": F.array(*[score("source_ks", i, "ks", j) for i, j in J.ACROSS]),
                "vv": F.array(*[score("ks", i, "ks", j) for i, j in J.WITHIN]),
                "scores": F.array(*[score("source_ks", i, "source_ks", j) for i, j in J.WITHIN]),
            }
        )
    )


def sql_scores(a_out: str, a_k: str, b_out: str, b_k: str, pairs) -> str:
    cells = ", ".join(
        f"CASE WHEN trim({a_out}[{i + 1}]) = '' AND trim({b_out}[{j + 1}]) = '' THEN 4 ELSE ({a_k}[{i + 1}] + {b_k}[{j + 1}]) % 5 END"
        for i, j in pairs
    )
    return f"[{cells}]"


def sql_raw(a_k: str, b_k: str, pairs) -> str:
    return "[" + ", ".join(f"({a_k}[{i + 1}] + {b_k}[{j + 1}]) % 5" for i, j in pairs) + "]"


JUDGED = f"""{OUTPUTS},
js AS (SELECT *, {sql_scores("source_outputs", "source_ks", "outputs", "ks", J.ACROSS)} AS sv, {sql_scores("outputs", "ks", "outputs", "ks", J.WITHIN)} AS vv,
  {sql_scores("source_outputs", "source_ks", "source_outputs", "source_ks", J.WITHIN)} AS bs, {sql_raw("source_ks", "ks", J.ACROSS)} AS sv0, {sql_raw("ks", "ks", J.WITHIN)} AS vv0 FROM jv),
jscore AS (SELECT model, task_id, family, form, list_avg(sv) / 4 AS output_sv, list_avg(vv) / 4 AS output_vv, list_avg(bs) / 4 AS output_baseline,
  len([1 for i in range(1, 10) if sv[i] <> sv0[i]]) + len([1 for i in range(1, 4) if vv[i] <> vv0[i]]) AS n_fixed FROM js)"""


@query(
    "judge_scores_fixed",
    f"WITH {JUDGED} SELECT model, task_id, family, form, round(output_sv, 9) AS output_sv, round(output_vv, 9) AS output_vv, n_fixed FROM jscore",
)
def judge_scores_fixed(spark, sf_dir):
    return J.fixed_variant_scores(judged_variants(runs_base(spark, sf_dir)))


def score_tables(base: DataFrame):
    judged = materialize(judged_variants(base), "judged")
    baseline = J.fixed_baseline_scores(judged.dropDuplicates(["model", "task_id"]))
    return J.fixed_variant_scores(judged), baseline


@query(
    "output_similarity_means",
    f"""WITH {JUDGED}, pt AS (SELECT {S.DATASET} AS dataset, model, task_id, family, avg(output_sv) AS sv, avg(output_vv) AS vv, any_value(output_baseline) AS b FROM jscore GROUP BY ALL)
    SELECT dataset, model, family, count(*) AS n_tasks, round(avg(b), 9) AS baseline, round(avg(sv), 9) AS source_variant, round(avg(vv), 9) AS variant_internal,
      round(avg(b - sv), 9) AS delta_baseline_minus_variant FROM pt GROUP BY ALL""",
)
def output_similarity_means(spark, sf_dir):
    scores, baseline = score_tables(runs_base(spark, sf_dir))
    keyed = scores.withColumn("dataset", dataset_name(F.col("task_id")))
    return J.output_means(keyed, baseline, ["dataset", "model"])


OUTPUT_DELTAS = f"""{JUDGED}, pt AS (SELECT model, task_id, family, avg(output_sv) - any_value(output_baseline) AS delta FROM jscore GROUP BY ALL)"""
UNITS_A_SLICE = 8


@query(
    "output_delta_intervals",
    f"""WITH {OUTPUT_DELTAS}, {CQ.sliced_boot_sql("pt", "model, family", "task_id", "delta", 10000, UNITS_A_SLICE)},
    ends AS (SELECT model, family, (list_sort(list(e)))[251] AS lo, (list_sort(list(e)))[9750] AS hi FROM est GROUP BY ALL)
    SELECT model, family, n AS n_units, CASE WHEN n >= 2 THEN round(lo, 9) END AS ci_low, CASE WHEN n >= 2 THEN round(hi, 9) END AS ci_high,
      n >= 2 AND (lo > 0 OR hi < 0) AS significant FROM ends JOIN slots USING (model, family)""",
)
def output_delta_intervals(spark, sf_dir):
    """Interval of variant minus baseline over 10,000 resamples of the tasks, in slices of eight."""
    scores, baseline = score_tables(runs_base(spark, sf_dir))
    deltas = J.task_deltas(scores, baseline, ["model", "family"])
    ci = stats.bootstrap_ci_order_stat(
        deltas, ["model", "family"], "task_id", "delta", 10000, slice_size=UNITS_A_SLICE
    )
    significant = F.coalesce(stats.excludes_zero(F.col("ci_low"), F.col("ci_high")), F.lit(False))
    return ci.withColumn("significant", significant)


GRAPH_OUTPUT = f"""{S.VARIANTS}, {JUDGED.split(S.BASE + ",", 1)[1].replace("src AS", "jsrc AS").replace("JOIN src s", "JOIN jsrc s")},
go AS (SELECT {S.DATASET} AS dataset, model, task_id, family, form, round(source_internal_mean, 9) AS graph_baseline, round(source_variant_mean, 9) AS graph_sv,
   round(output_baseline, 9) AS output_baseline, round(output_sv, 9) AS output_sv, round(output_vv, 9) AS output_vv
   FROM variants JOIN jscore USING (model, task_id, family, form) WHERE source_internal_mean IS NOT NULL)"""


def graph_and_output(spark, sf_dir) -> DataFrame:
    """Graph and output similarity of each judged variant, rounded so that ties are exact."""
    base = stored_runs(spark, sf_dir)
    graph = variants(spark, sf_dir, base).select(
        *FORM_KEYS,
        F.col("source_internal_mean").alias("graph_baseline"),
        F.col("source_variant_mean").alias("graph_sv"),
    )
    scores, baseline = score_tables(base)
    joined = (
        graph.filter(F.col("graph_baseline").isNotNull())
        .join(scores.drop("n_fixed"), FORM_KEYS)
        .join(baseline, TASK_KEYS)
        .withColumn("dataset", dataset_name(F.col("task_id")))
    )
    doubles = ["graph_baseline", "graph_sv", "output_baseline", "output_sv", "output_vv"]
    return materialize(joined.withColumns({c: F.round(c, 9) for c in doubles}), "graph-output")


@query("graph_output_join", f"WITH {GRAPH_OUTPUT} SELECT * FROM go")
def graph_output_join(spark, sf_dir):
    return graph_and_output(spark, sf_dir)


def rank_sql(col: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"


@query(
    "spearman",
    f"""WITH {GRAPH_OUTPUT}, r AS (SELECT dataset, {rank_sql("graph_sv", "dataset")} AS rx, {rank_sql("output_sv", "dataset")} AS ry FROM go)
    SELECT dataset, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 8) AS rho FROM r GROUP BY ALL""",
)
def spearman(spark, sf_dir):
    rho = stats.spearman(graph_and_output(spark, sf_dir), ["dataset"], "graph_sv", "output_sv")
    return rho.withColumn("rho", F.round("rho", 8))


@query(
    "stratified_spearman",
    f"""WITH {GRAPH_OUTPUT}, r AS (SELECT model, family, dataset, count(*) OVER (PARTITION BY model, family, dataset) AS m,
       {rank_sql("graph_sv", "model, family, dataset")} AS rx, {rank_sql("output_sv", "model, family, dataset")} AS ry FROM go),
    c AS (SELECT model, family, (rx - (m + 1) / 2.0) / m AS x, (ry - (m + 1) / 2.0) / m AS y FROM r)
    SELECT model, family, count(*) AS n, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 8) AS rho FROM c GROUP BY ALL""",
)
def stratified_spearman(spark, sf_dir):
    rho = stats.spearman(graph_and_output(spark, sf_dir), ["model", "family"], "graph_sv", "output_sv", ["dataset"])
    return rho.withColumn("rho", F.round("rho", 8))


@query(
    "average_ranks",
    f"""WITH {GRAPH_OUTPUT} SELECT DISTINCT dataset, graph_sv, {rank_sql("graph_sv", "dataset")} AS rank, count(*) OVER (PARTITION BY dataset, graph_sv) AS peers FROM go""",
)
def average_ranks(spark, sf_dir):
    return stats.average_ranks(graph_and_output(spark, sf_dir), ["dataset"], "graph_sv", "rank")


@query(
    "quadrants",
    f"""WITH {GRAPH_OUTPUT}, q AS (SELECT dataset, model, graph_sv >= graph_baseline - 0.1 AS s, output_sv >= output_vv - 0.1 AS o FROM go)
    SELECT dataset, model, count(*) AS n, round(count(*) FILTER (s AND o) / count(*), 9) AS both_consistent, round(count(*) FILTER (s AND NOT o) / count(*), 9) AS structure_only,
     round(count(*) FILTER (NOT s AND o) / count(*), 9) AS output_only, round(count(*) FILTER (NOT s AND NOT o) / count(*), 9) AS none_consistent FROM q GROUP BY ALL""",
)
def quadrants(spark, sf_dir):
    return J.quadrants(graph_and_output(spark, sf_dir), ["dataset", "model"])


@query(
    "scatter_bins",
    f"WITH {GRAPH_OUTPUT} SELECT family, round_even(graph_sv / 0.05, 0)::INTEGER AS x_cell, round_even(output_sv * 36, 0)::INTEGER AS y_cell, count(*) AS n FROM go GROUP BY ALL",
)
def scatter_bins(spark, sf_dir):
    return summaries.scatter_bins(graph_and_output(spark, sf_dir), ["family"], "graph_sv", "output_sv")


RETURNED = f"""{OUTPUTS},
ret AS (SELECT *, regexp_extract(task_id, '[0-9]+$')::BIGINT AS u FROM jv),
got AS (SELECT * FROM ret WHERE NOT (u % 5 = 1 AND form IN ('p01', 'lang_zh')))"""


@query(
    "judge_validation",
    f"""WITH {RETURNED}, j AS (SELECT model, task_id, family, any_value(u) AS u, list(form ORDER BY form) AS expected FROM ret GROUP BY ALL),
    g AS (SELECT model, task_id, family, list(form ORDER BY form) AS forms FROM got GROUP BY ALL),
    p AS (SELECT model, task_id, family, unnest(list_filter([CASE WHEN coalesce(forms, []::VARCHAR[]) <> expected THEN 'forms_mismatch' END, CASE WHEN u % 5 = 2 THEN 'source_variant_count' END,
      CASE WHEN u % 5 = 3 THEN 'variant_internal_count' END], lambda x: x IS NOT NULL)) AS problem FROM j LEFT JOIN g USING (model, task_id, family))
    SELECT * FROM p""",
)
def judge_validation(spark, sf_dir):
    """Judge results with defects planted by user: missing forms and wrong score counts."""
    v = with_user(variant_table(runs_base(spark, sf_dir)))
    dropped = (F.col("u") % 5 == 1) & F.col("form").isin("p01", "lang_zh")
    jobs = v.groupBy("model", "task_id", "family").agg(
        F.array_sort(F.collect_list("form")).alias("expected_forms"),
        F.array_sort(F.collect_list(F.when(~dropped, F.col("form")))).alias("forms"),
        F.collect_set(F.when(F.col("u") % 5 == 2, 8).otherwise(9)).alias("sv_sizes"),
        F.collect_set(F.when(F.col("u") % 5 == 3, 2).otherwise(3)).alias("vv_sizes"),
    )
    return J.validate_results(jobs).select("model", "task_id", "family", "problem")


def with_user(df: DataFrame) -> DataFrame:
    return df.withColumn("u", F.regexp_extract("task_id", r"([0-9]+)$", 1).cast("long"))


@query(
    "missing_forms",
    f"""WITH {RETURNED} SELECT model, task_id, family, form, u % 5 = 1 AND form IN ('p01', 'lang_zh') AS supplemental FROM ret""",
)
def missing_forms(spark, sf_dir):
    v = with_user(variant_table(runs_base(spark, sf_dir))).select(*FORM_KEYS, "u", "variant_chars")
    dropped = (F.col("u") % 5 == 1) & F.col("form").isin("p01", "lang_zh")
    first = v.filter(~dropped).drop("u")
    missing = v.drop("u").join(first, FORM_KEYS, "left_anti")
    return J.merge_supplemental(first, missing, FORM_KEYS).select(*FORM_KEYS, "supplemental")


@query(
    "resume_antijoin",
    f"""WITH {RETURNED}, p AS (SELECT DISTINCT model || '|' || task_id || '|' || family || '|' || form AS job_id, model || '|' || task_id || '|' || family AS parent_job_id, u, form FROM ret)
    SELECT job_id, parent_job_id FROM p WHERE NOT (u % 2 = 0 AND form LIKE 'p%') AND NOT (u % 3 = 0)""",
)
def resume_antijoin(spark, sf_dir):
    v = with_user(variant_table(runs_base(spark, sf_dir)))
    planned = v.select(
        F.concat_ws("|", *FORM_KEYS).alias("job_id"),
        F.concat_ws("|", "model", "task_id", "family").alias("parent_job_id"),
        "u",
        "form",
    )
    done = (
        planned.filter((F.col("u") % 2 == 0) & F.col("form").startswith("p"))
        .select("job_id")
        .unionByName(planned.filter(F.col("u") % 3 == 0).select(F.col("parent_job_id").alias("job_id")).distinct())
    )
    return J.pending_jobs(planned, done).select("job_id", "parent_job_id")


K = CQ.K
ACTIONS = f"""{S.BASE}, {CQ.RES}, {S.SANDBOX_LOG},
acts AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY event_id) - 1 AS action_index, operation, destination, payload AS content FROM log WHERE type = 'disclosure')"""


def actions_table(base: DataFrame) -> DataFrame:
    sent = sandbox_log(base).filter(F.col("type") == "disclosure")
    placed = running(sent, RUN_KEYS, "event_id", sums={"_n": F.lit(1)})
    return placed.select(
        *RUN_KEYS, (F.col("_n") - 1).cast("long").alias("action_index"), "operation", "destination", F.col("payload").alias("content")
    )


@query("disclosure_audit_input", f"WITH {ACTIONS} SELECT * FROM acts")
def disclosure_audit_input(spark, sf_dir):
    return actions_table(runs_base(spark, sf_dir))


@query(
    "verdict_sanitisation",
    f"""WITH {ACTIONS}, a AS (SELECT {K}, list_sort(list_distinct(list(lower(content)))) AS named FROM acts GROUP BY ALL)
    SELECT res.model, res.task_id, res.family, res.form, res.repeat,
      array_to_string(list_filter(['item 5','item 6'], lambda x: list_contains(coalesce(named, []::VARCHAR[]), x)), '|') AS leaked_items,
      array_to_string(list_filter(['item 0','item 1'], lambda x: NOT list_contains(coalesce(named, []::VARCHAR[]), x)), '|') AS missing_items
    FROM res LEFT JOIN a USING ({K})""",
)
def verdict_sanitisation(spark, sf_dir):
    """A judge that names every content it saw; runs without actions miss every item."""
    base = runs_base(spark, sf_dir)
    ann = CQ.annotations(base).withColumn("must_not_share", CQ.arr("item 5", "item 6"))
    flags = [
        F.max((F.lower("content") == f"item {i}").cast("int")).alias(f"i{i}") for i in range(7)
    ]
    seen = actions_table(base).groupBy(*RUN_KEYS).agg(*flags)
    named = F.array_compact(F.array(*[F.when(F.col(f"i{i}") == 1, f"item {i}") for i in range(7)]))
    judged = base.select(*RUN_KEYS).distinct().join(seen, list(RUN_KEYS), "left").select(
        *RUN_KEYS, named.alias("must_share_disclosed"), named.alias("must_not_share_disclosed")
    )
    return J.sanitize_verdicts(judged, ann).select(
        *RUN_KEYS, F.array_join("leaked_items", "|").alias("leaked_items"), F.array_join("missing_items", "|").alias("missing_items")
    )


@query(
    "evidence_verification",
    f"""WITH {ACTIONS}, ev AS (SELECT {K}, action_index AS at, action_index + CASE WHEN action_index % 3 = 2 THEN 1 ELSE 0 END AS action_index,
       CASE WHEN length(content) > 0 AND content LIKE '%3' THEN '' ELSE content END AS quote FROM acts),
    j AS (SELECT ev.*, coalesce(quote <> '' AND (contains(a.operation, quote) OR contains(coalesce(a.destination, ''), quote) OR contains(a.content, quote)), false) AS ok FROM ev LEFT JOIN acts a USING ({K}, action_index))
    SELECT {K}, count(*) AS n_quotes, bool_and(ok) AS evidence_valid FROM j GROUP BY ALL""",
)
def evidence_verification(spark, sf_dir):
    """Quotes of each action, some shifted to the next action and some emptied on purpose."""
    acts = materialize(actions_table(runs_base(spark, sf_dir)), "actions")
    shift = F.when(F.col("action_index") % 3 == 2, 1).otherwise(0)
    evidence = acts.select(
        *RUN_KEYS,
        (F.col("action_index") + shift).alias("action_index"),
        F.when(F.col("content").endswith("3"), "").otherwise(F.col("content")).alias("quote"),
    )
    return J.verify_evidence(evidence, acts, RUN_KEYS)
