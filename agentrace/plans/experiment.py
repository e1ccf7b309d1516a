"""Queries over the plan of an experiment and the attributes of its tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentrace.operators import experiment as E
from agentrace.operators import variants as V
from agentrace.plans import fixture_sql as S
from agentrace.plans import similarity as SIM
from agentrace.plans import variants as PV
from agentrace.plans.registry import query
from agentrace.session import materialize
from agentrace.sources.tables import table

REORDERED = ("context_to_end", "parallel_action_rotation")
_shared = PV.USERS + ","
PLAN = f"""{PV.CANDIDATES}, {PV.RENDERED.replace(_shared, "")}, {PV.SENT.replace(_shared, "")},
re AS (SELECT task_id, array_to_string(p, ' ') AS prompt FROM pp WHERE transformation IN {REORDERED}),
plan AS (
  SELECT task_id, 'source' AS family, 'source' AS form, source AS prompt, NULL::VARCHAR AS tone, NULL::VARCHAR AS language, NULL::VARCHAR AS subtype, true AS strict_mt_eligible FROM usr
  UNION ALL SELECT task_id, 'tone', form, prompt, tone, NULL, NULL, valid AND NOT context_sensitive FROM tone
  UNION ALL SELECT task_id, 'multilingual', 'lang_' || language, variant, NULL, language, NULL, eligible_pilot FROM el
  UNION ALL SELECT task_id, 'information_order', 'order_' || transformation, array_to_string(p, ' '), NULL, NULL, transformation, true FROM pp WHERE transformation IN {REORDERED} AND p <> s
  UNION ALL SELECT task_id, 'formulation', 'formulation', coalesce(re.prompt, best.prompt), NULL, NULL,
    CASE WHEN re.prompt IS NOT NULL THEN 'information_reordering' ELSE 'constrained_paraphrasing' END, re.prompt IS NOT NULL OR best.passed
    FROM usr LEFT JOIN re USING (task_id) LEFT JOIN best USING (task_id))"""


def sources(spark, sf_dir):
    return PV.user_prompts(spark, sf_dir).select("task_id", F.col("source").alias("prompt"))


def plan(spark, sf_dir):
    tone = PV.rendered(spark, sf_dir).withColumn("eligible_pilot", F.col("valid"))
    multilingual = PV.audited(spark, sf_dir).select(
        "task_id", F.concat(F.lit("lang_"), "language").alias("form"), F.col("variant").alias("prompt"), "language", "eligible_pilot"
    )
    moved = PV.permuted(spark, sf_dir).filter(F.col("transformation").isin(*REORDERED)).select(
        "task_id", "transformation", "order_changed", F.array_join("permuted", " ").alias("prompt")
    )
    order = moved.select(
        "task_id", F.concat(F.lit("order_"), "transformation").alias("form"), "prompt",
        F.col("transformation").alias("subtype"), F.col("order_changed").alias("eligible_pilot"),
    )
    best = V.choose_candidate(PV.candidates(spark, sf_dir), [F.col("candidate_id")])
    routed = V.route_formulation(PV.user_prompts(spark, sf_dir), moved, best).withColumn("form", F.lit("formulation"))
    return E.experiment_plan(sources(spark, sf_dir), tone, multilingual, order, routed)


@query(
    "experiment_plan",
    f"WITH {PLAN} SELECT task_id, {S.DATASET} AS dataset, family, form, prompt, tone, language, subtype, strict_mt_eligible FROM plan",
)
def experiment_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query(
    "plan_gaps",
    f"""WITH {PLAN}, pr AS (SELECT task_id, family, form, count(*) AS n, count(prompt) AS prompts FROM plan GROUP BY ALL)
    SELECT task_id, family, form, 'no prompt' AS reason FROM pr WHERE prompts < n
    UNION ALL SELECT task_id, family, form, 'planned twice' FROM pr WHERE n > 1
    UNION ALL SELECT u.task_id, f.family, NULL, 'no form' FROM (SELECT DISTINCT task_id FROM usr) u, (SELECT unnest({list(E.FAMILIES)}) AS family) f
      WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.task_id = u.task_id AND pr.family = f.family)""",
)
def plan_gaps(spark, sf_dir):
    return E.plan_gaps(materialize(plan(spark, sf_dir), "plan"), sources(spark, sf_dir))


# Overrides of most forms; some lines were made from another prompt, some are stale earlier lines.
OVERRIDDEN = f"""{PLAN}, lines AS (
  SELECT 1 AS line_no, task_id, form, CASE WHEN length(prompt) % 7 = 0 THEN prompt || ' ' ELSE prompt END AS prompt, 'Task: ' || prompt AS extracted, sha256(form) AS system_sha256
    FROM plan WHERE prompt IS NULL OR length(prompt) % 11 <> 0
  UNION ALL SELECT 0, task_id, form, 'stale', 'stale', 'stale' FROM plan WHERE length(prompt) % 5 = 0),
ov AS (SELECT task_id, form, true AS found, prompt AS override_prompt, extracted, system_sha256 FROM lines
  QUALIFY row_number() OVER (PARTITION BY task_id, form ORDER BY line_no DESC) = 1),
dec AS (SELECT p.*, o.override_prompt, o.extracted, o.system_sha256, CASE WHEN o.found IS NULL THEN 'no override'
  WHEN o.override_prompt IS DISTINCT FROM p.prompt THEN 'made from a different prompt' END AS reason FROM plan p LEFT JOIN ov o USING (task_id, form))"""


def overridden(spark, sf_dir):
    planned = materialize(plan(spark, sf_dir), "plan")
    size = F.char_length("prompt")
    line = lambda n, prompt, extracted, sha: planned.select(
        F.lit(n).alias("line_no"), "task_id", "form", prompt.alias("_p"), extracted.alias("extracted"), sha.alias("system_sha256"), "prompt"
    )
    other = F.when(size % 7 == 0, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt"))
    made = line(1, other, F.concat(F.lit("Task: "), "prompt"), F.sha2("form", 256)).filter(F.col("prompt").isNull() | (size % 11 != 0))
    stale = line(0, F.lit("stale"), F.lit("stale"), F.lit("stale")).filter(size % 5 == 0)
    lines = made.unionByName(stale).drop("prompt").withColumnRenamed("_p", "prompt")
    return E.with_overrides(planned, lines)


@query("prompt_conflicts", f"WITH {OVERRIDDEN} SELECT task_id, family, form, prompt, override_prompt, reason FROM dec WHERE reason IS NOT NULL")
def prompt_conflicts(spark, sf_dir):
    return E.conflicts(overridden(spark, sf_dir))


@query(
    "overridden_plan",
    f"""WITH {OVERRIDDEN} SELECT task_id, family, form, extracted AS prompt, prompt AS original_prompt, system_sha256 AS prompt_override_sha256, strict_mt_eligible
    FROM dec WHERE reason IS NULL""",
)
def overridden_plan(spark, sf_dir):
    return E.accepted(overridden(spark, sf_dir)).select(
        "task_id", "family", "form", "prompt", "original_prompt", "prompt_override_sha256", "strict_mt_eligible"
    )


# Tasks of the logs belong to users; a customer's segment and nation stand for category and domain.
DIMENSION = """dim AS (SELECT (CASE (c_custkey // 3) % 3 WHEN 0 THEN 'AIP-' WHEN 1 THEN 'ACB-' ELSE 'TJB-' END) || lpad(c_custkey::VARCHAR, 6, '0') AS task_id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS task_category, n_name AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0)"""


def dimension(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    which = F.floor(key / 3) % 3
    prefix = F.when(which == 0, "AIP-").when(which == 1, "ACB-").otherwise("TJB-")
    rows = c.filter(key % 13 != 0).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.concat(prefix, F.lpad(key.cast("string"), 6, "0")).alias("task_id"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("task_type"),
        F.col("n_name").alias("domain"),
    )
    earlier = rows.select("task_id", F.lit("superseded").alias("task_type"), F.lit("superseded").alias("domain"))
    lines = earlier.withColumn("line_no", F.lit(0)).unionByName(rows.withColumn("line_no", F.lit(1)))
    return E.task_dimension(lines)


@query(
    "variant_task_attributes",
    f"""WITH {S.VARIANTS}, {DIMENSION} SELECT model, {S.DATASET} AS dataset, task_id, task_category, domain, family, form,
    round(source_variant_mean, 9) AS source_variant_mean, round(delta_baseline_minus_variant, 9) AS delta_baseline_minus_variant FROM variants LEFT JOIN dim USING (task_id)""",
)
def variant_task_attributes(spark, sf_dir):
    """The category and domain of its task on every variant score."""
    scores = E.with_task_attributes(SIM.variants(spark, sf_dir), dimension(spark, sf_dir))
    return scores.select(
        "model", E.dataset_name(F.col("task_id")).alias("dataset"), "task_id", "task_category", "domain",
        "family", "form", "source_variant_mean", "delta_baseline_minus_variant",
    )


@query(
    "category_scores",
    f"""WITH {S.VARIANTS}, {DIMENSION} SELECT model, task_category, domain, family, count(*) AS n_variants, count(DISTINCT task_id) AS n_tasks,
    round(avg(source_variant_mean), 9) AS source_variant_mean, round(avg(delta_baseline_minus_variant), 9) AS delta_baseline_minus_variant
    FROM variants LEFT JOIN dim USING (task_id) GROUP BY ALL""",
)
def category_scores(spark, sf_dir):
    scores = E.with_task_attributes(SIM.variants(spark, sf_dir), dimension(spark, sf_dir))
    return scores.groupBy("model", *E.TASK_COLUMNS, "family").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.count_distinct("task_id").alias("n_tasks"),
        F.avg("source_variant_mean").alias("source_variant_mean"),
        F.avg("delta_baseline_minus_variant").alias("delta_baseline_minus_variant"),
    )
