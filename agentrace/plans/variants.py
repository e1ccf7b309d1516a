"""Queries over prompt variants: templates, permutations, literal checks, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.functions import literals as L
from agentrace.functions.text import ascii_ratio
from agentrace.operators import variants as V
from agentrace.plans.registry import query
from agentrace.sources.tables import table

PREFIX = "CASE conv_id % 3 WHEN 0 THEN 'AIP-' WHEN 1 THEN 'ACB-' ELSE 'TJB-' END || conv_id || '-' || turn"
TAIL = 'Call 5 of 12,5 at 10:30 on the 3rd. Visit https://x.io/a?b=1 or mail a.b@c.org, "Quoted text". Pay $1,200 to ID-77 today for all OpenDesk #tag users.'
CODE = 'Run `make all` with --fast on /etc/app.conf and my_file.py, then call go() for $HOME.'

USERS = f"""usr AS (SELECT conv_id, turn, {PREFIX} AS task_id, text, text || ' {TAIL}' AS source,
  CASE conv_id % 5 WHEN 0 THEN regexp_replace(text || ' {TAIL}', '[0-9]', '', 'g')
    WHEN 1 THEN replace(text || ' {TAIL}', 'https://x.io/a?b=1', 'the site') ELSE replace(text, 'e', 'E') || ' {TAIL}' END AS variant,
  (['fr','de','es'])[turn % 3 + 1] AS language FROM conversations WHERE role = 'user')"""


def user_prompts(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    prefix = F.when(F.col("conv_id") % 3 == 0, "AIP-").when(F.col("conv_id") % 3 == 1, "ACB-").otherwise("TJB-")
    source = F.concat("text", F.lit(" " + TAIL))
    variant = (
        F.when(F.col("conv_id") % 5 == 0, F.regexp_replace(source, "[0-9]", ""))
        .when(F.col("conv_id") % 5 == 1, F.replace(source, F.lit("https://x.io/a?b=1"), F.lit("the site")))
        .otherwise(F.concat(F.replace(F.col("text"), F.lit("e"), F.lit("E")), F.lit(" " + TAIL)))
    )
    lang = F.when(F.col("turn") % 3 == 0, "fr").when(F.col("turn") % 3 == 1, "de").otherwise("es")
    return t.select(
        "conv_id",
        "turn",
        F.concat(prefix, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("task_id"),
        "text",
        source.alias("source"),
        variant.alias("variant"),
        lang.alias("language"),
    )


TONES = ", ".join(
    "('{}', '{}', '{}', {})".format(i, t, s.replace("'", "''"), str(i in V.CONTEXT_SENSITIVE).lower())
    for i, t, s in V.TONE_FORMS
)
RENDERED = f"""{USERS},
tin AS (SELECT task_id, CASE WHEN conv_id % 2 = 0 THEN ' I am busy. ' END AS context, CASE WHEN conv_id % 7 = 3 THEN text ELSE lower(substr(text, 1, 1)) || substr(text, 2) END AS task FROM usr),
tc AS (SELECT task_id, context, rtrim(trim(task), '.?!') AS core FROM tin),
tf AS (SELECT *, core <> '' AND lower(core[1]) = core[1] AND upper(core[1]) <> core[1] AS valid FROM tc),
tone AS (SELECT task_id, form, tone, context_sensitive, valid, CASE WHEN valid THEN CASE WHEN context IS NOT NULL THEN trim(context) || chr(10) || chr(10) ELSE '' END
   || replace(replace(template, '{{task}}', core), '{{Task}}', upper(core[1]) || substr(core, 2)) END AS prompt
  FROM tf, (VALUES {TONES}) v(form, tone, template, context_sensitive))"""


def rendered(spark, sf_dir):
    u = user_prompts(spark, sf_dir)
    lowered = F.concat(F.lower(F.substring("text", 1, 1)), F.substring(F.col("text"), F.lit(2), F.length("text")))
    tasks = u.select(
        "task_id",
        F.when(F.col("conv_id") % 2 == 0, " I am busy. ").alias("context"),
        F.when(F.col("conv_id") % 7 == 3, F.col("text")).otherwise(lowered).alias("task"),
    )
    return V.tone_templates(tasks)


@query("tone_templates", f"WITH {RENDERED} SELECT * FROM tone")
def tone_templates(spark, sf_dir):
    return rendered(spark, sf_dir)


@query(
    "tone_inventory",
    f"WITH {RENDERED} SELECT tone, context_sensitive, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM tone GROUP BY ALL",
)
def tone_inventory(spark, sf_dir):
    return rendered(spark, sf_dir).groupBy("tone", "context_sensitive").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid")
    )


def sentences_sql(x: str) -> str:
    prot = f"regexp_replace({x}, '\\b(Dr|Mr|Mrs|Ms|Prof|St)\\.', '\\1<DOT>', 'g')"
    cut = f"regexp_replace({prot}, '([.!?])\\s+([\"“”''A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(replace(s, '<DOT>', '.'))), lambda s: s <> '')"


SENT = f"""{USERS}, st AS (SELECT task_id, conv_id, CASE WHEN task_id LIKE 'AIP-%' THEN 'permission' WHEN task_id LIKE 'ACB-%' THEN 'sandbox' ELSE 'trajectory' END AS dataset,
  CASE WHEN turn % 4 = 0 THEN 'parallel' ELSE 'sequential' END AS trajectory_type, {sentences_sql("'See Dr. Who. ' || text")} AS s FROM usr),
pm AS (SELECT *, CASE WHEN len(s) < 2 THEN 'not_applicable' WHEN conv_id % 9 = 4 THEN 'excluded_dependency'
   WHEN dataset = 'trajectory' AND trajectory_type = 'parallel' AND len(s) > 2 THEN 'parallel_action_rotation' ELSE 'context_to_end' END AS transformation FROM st),
pp AS (SELECT *, CASE transformation WHEN 'not_applicable' THEN s WHEN 'excluded_dependency' THEN s
   WHEN 'parallel_action_rotation' THEN list_concat(s[1:1], s[3:], s[2:2]) ELSE list_concat(s[2:], s[1:1]) END AS p FROM pm)"""


def permuted(spark, sf_dir):
    from agentrace.operators.logs import dataset_name

    u = user_prompts(spark, sf_dir)
    tasks = u.select(
        "task_id",
        dataset_name(F.col("task_id")).alias("dataset"),
        F.when(F.col("turn") % 4 == 0, "parallel").otherwise("sequential").alias("trajectory_type"),
        V.split_sentences(F.concat(F.lit("See Dr. Who. "), F.col("text"))).alias("sentences"),
    )
    exclusions = u.filter(F.col("conv_id") % 9 == 4).select("task_id")
    return V.controlled_permutation(tasks, exclusions)


@query(
    "sentence_permutation",
    f"""WITH {SENT} SELECT task_id, transformation, array_to_string(p, '¦') AS permuted, list_sort(p) = list_sort(s) AS multiset_preserved, p <> s AS order_changed FROM pp""",
)
def sentence_permutation(spark, sf_dir):
    return permuted(spark, sf_dir).select(
        "task_id", "transformation", F.array_join("permuted", "¦").alias("permuted"), "multiset_preserved", "order_changed"
    )


@query(
    "reordering_summary",
    f"WITH {SENT} SELECT dataset, transformation, count(*) AS n, count(*) FILTER (p <> s) AS n_changed FROM pp GROUP BY ALL",
)
def reordering_summary(spark, sf_dir):
    return permuted(spark, sf_dir).groupBy("dataset", "transformation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("order_changed").alias("n_changed")
    )


@query(
    "seeded_permutation",
    f"""WITH {SENT}, ix AS (SELECT task_id, s, unnest(range(len(s))) AS i FROM st),
    o AS (SELECT task_id, any_value(s) AS s, list(i ORDER BY sha256(task_id || '|' || i), i) AS ord FROM ix GROUP BY ALL)
    SELECT task_id, array_to_string(CASE WHEN len(s) < 2 THEN s WHEN ord = range(len(s)) THEN list_concat(s[2:], s[1:1]) ELSE [ s[j + 1] for j in ord ] END, '¦') AS permuted FROM o""",
)
def seeded_permutation(spark, sf_dir):
    u = user_prompts(spark, sf_dir).withColumn("s", V.split_sentences(F.concat(F.lit("See Dr. Who. "), F.col("text"))))
    return u.select("task_id", F.array_join(V.seeded_permutation(F.col("s"), F.col("task_id")), "¦").alias("permuted"))


@query(
    "context_to_end",
    f"""WITH {USERS}, b AS (SELECT task_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM usr),
    f AS (SELECT *, regexp_extract(body, '(?s)^(.+?[.!?])\\s+\\S', 1) AS first FROM b),
    r AS (SELECT *, regexp_replace(substr(body, length(first) + 1), '^\\s+', '') AS rest FROM f)
    SELECT task_id, CASE WHEN first <> '' THEN rest || CASE WHEN contains(rest, chr(10)) THEN chr(10) || chr(10) ELSE ' ' END || first || chr(10) END AS prompt FROM r""",
)
def context_to_end(spark, sf_dir):
    return user_prompts(spark, sf_dir).select("task_id", V.context_to_end(F.col("text")).alias("prompt"))


NUM = r"[^0-9A-Za-z_]([+-]?[0-9]+(?:[.,:][0-9]+)*(?:st|nd|rd|th)?)"
STR_SQL = """list_transform(list_sort(list_distinct(list_concat(regexp_extract_all({x}, '"([^"\\n]+)"', 1), regexp_extract_all({x}, 'https?://[^\\s<>"'']+'),
  regexp_extract_all({x}, '\\b[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}\\b')))), lambda v: rtrim(v, '.,;'))"""
AUDIT = f"""{USERS},
au AS (SELECT *, list_filter({STR_SQL.format(x="source")}, lambda v: NOT contains(variant, v)) AS ms,
  list_sort(list_filter(list_distinct(regexp_extract_all(' ' || source, '{NUM}', 1)), lambda v: NOT list_contains(regexp_extract_all(' ' || variant, '{NUM}', 1), v))) AS mn FROM usr),
el AS (SELECT *, len(ms) = 0 AND len(mn) = 0 AS passed, turn % 6 = 4 AS context_sensitive, len(ms) = 0 AND len(mn) = 0 AND turn % 8 <> 0 AND turn % 6 <> 4 AS eligible_pilot FROM au)"""


def audited(spark, sf_dir):
    u = user_prompts(spark, sf_dir)
    review = F.struct(
        *[
            (F.col("turn") % 8 != 0 if flag == "tone_preserved" else F.lit(True)).alias(flag)
            for flag in V.REVIEW_FLAGS
        ]
    )
    checked = V.literal_audit(u, "source", "variant", ascii_numbers=True)
    return V.eligibility(
        checked.withColumn("review", review).withColumn("context_sensitive", F.col("turn") % 6 == 4)
    )


@query(
    "literal_preservation",
    f"WITH {AUDIT} SELECT task_id, array_to_string(ms, '|') AS missing_strings, array_to_string(mn, '|') AS missing_numbers, passed FROM el",
)
def literal_preservation(spark, sf_dir):
    return audited(spark, sf_dir).select(
        "task_id",
        F.array_join("missing_strings", "|").alias("missing_strings"),
        F.array_join(F.array_sort("missing_numbers"), "|").alias("missing_numbers"),
        "passed",
    )


@query(
    "numeric_tokens_audit",
    f"""WITH {USERS}, n AS (SELECT unnest(list_distinct(regexp_extract_all(' ' || source, '{NUM}', 1))) AS token FROM usr) SELECT token, count(*) AS n FROM n GROUP BY ALL""",
)
def numeric_tokens_audit(spark, sf_dir):
    return (
        user_prompts(spark, sf_dir)
        .select(F.explode(L.numeric_tokens(F.col("source"))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "eligibility_audit",
    f"""WITH {AUDIT} SELECT language, count(*) AS candidates, count(*) FILTER (eligible_pilot) AS eligible, count(*) FILTER (NOT passed) AS literal_check_failures,
    count(*) FILTER (context_sensitive) AS context_sensitive_candidates, count(*) FILTER (NOT eligible_pilot) AS needs_review FROM el GROUP BY ALL""",
)
def eligibility_audit(spark, sf_dir):
    return V.audit_summary(audited(spark, sf_dir), ["language"])


@query("review_queue", f"WITH {AUDIT} SELECT task_id, language, passed FROM el WHERE NOT eligible_pilot")
def review_queue(spark, sf_dir):
    return V.review_queue(audited(spark, sf_dir)).select("task_id", "language", "passed")


@query(
    "suite_flatten",
    f"""WITH {AUDIT} SELECT task_id, 'en' AS language, source AS prompt, false AS is_translation, 'source' AS status FROM el
    UNION ALL SELECT task_id, language, variant, true, CASE WHEN eligible_pilot THEN 'automated_checks_passed' ELSE 'needs_review' END FROM el""",
)
def suite_flatten(spark, sf_dir):
    rows = audited(spark, sf_dir)
    source = F.struct(
        F.lit("en").alias("language"),
        F.col("source").alias("prompt"),
        F.lit(False).alias("is_translation"),
        F.lit("source").alias("status"),
    )
    translated = F.struct(
        F.col("language").alias("language"),
        F.col("variant").alias("prompt"),
        F.lit(True).alias("is_translation"),
        F.when(F.col("eligible_pilot"), "automated_checks_passed").otherwise("needs_review").alias("status"),
    )
    return rows.select("task_id", F.inline(F.array(source, translated)))


# SQL word boundaries know ASCII letters only, so other letters are read as "x" there.
PLAIN = "regexp_replace(source, '[^\\x00-\\x7F]', 'x', 'g')"
LIT_SQL = "list_distinct(list_concat(" + ", ".join(
    "regexp_extract_all({}, '{}')".format(
        PLAIN,
        (p.replace("(?U)", "") if i != 3 else '"[^"\\n]+"').replace("'", "''")
    )
    for i, p in enumerate(L.LITERALS)
) + "))"
TEMP_SQL = ", ".join(f"regexp_extract_all({PLAIN}, '(?i){p}')" for p in L.TEMPORAL_SCOPE)


@query(
    "protected_literals",
    f"""WITH {USERS}, l AS (SELECT task_id, source, unnest({LIT_SQL}) AS v FROM usr)
    SELECT task_id, string_agg(v, '¦' ORDER BY instr(source, v), v) AS literals, count(*) AS n FROM l GROUP BY task_id""",
)
def protected_literals(spark, sf_dir):
    found = L.protected_literals(F.col("source"))
    return user_prompts(spark, sf_dir).select(
        "task_id", F.array_join(found, "¦").alias("literals"), F.size(found).cast("long").alias("n")
    )


@query(
    "locked_spans",
    f"""WITH {USERS}, l AS (SELECT task_id, source, list_distinct(list_concat({LIT_SQL}, {TEMP_SQL})) AS vs FROM usr),
    u AS (SELECT task_id, source, vs, unnest(vs) AS v FROM l),
    k AS (SELECT * FROM u WHERE len(list_filter(vs, lambda k: length(k) > length(v) AND contains(k, v))) = 0)
    SELECT task_id, string_agg(v, '¦' ORDER BY length(v) DESC, instr(source, v), v) AS spans FROM k GROUP BY task_id""",
)
def locked_spans(spark, sf_dir):
    return user_prompts(spark, sf_dir).select(
        "task_id", F.array_join(L.locked_spans(F.col("source")), "¦").alias("spans")
    )


@query(
    "missing_locked_spans",
    f"""WITH {USERS}, l AS (SELECT task_id, source, variant, list_distinct(list_concat({LIT_SQL}, {TEMP_SQL})) AS vs FROM usr),
    u AS (SELECT task_id, variant, vs, unnest(vs) AS v FROM l),
    k AS (SELECT * FROM u WHERE len(list_filter(vs, lambda k: length(k) > length(v) AND contains(k, v))) = 0)
    SELECT task_id, count(*) FILTER (NOT contains(variant, v)) AS n_missing FROM k GROUP BY task_id""",
)
def missing_locked_spans(spark, sf_dir):
    spans = L.locked_spans(F.col("source"))
    return user_prompts(spark, sf_dir).select(
        "task_id", F.size(L.missing(spans, F.col("variant"))).cast("long").alias("n_missing")
    )


@query("literal_shielding", f"WITH {USERS} SELECT task_id, true AS hides_all, true AS lossless FROM usr")
def literal_shielding(spark, sf_dir):
    lits = L.protected_literals(F.col("source"))
    shielded = L.shield_literals(F.col("source"), lits)
    return user_prompts(spark, sf_dir).select(
        "task_id",
        (~F.contains(shielded, F.lit("https://x.io"))).alias("hides_all"),
        (L.restore_literals(shielded, lits) == F.col("source")).alias("lossless"),
    )


MASK_SQL = L.MASK.replace("(?sU)", "(?s)").replace("(?<![\\w])", "").replace("(?<![\\w-])", "").replace("'", "''")


@query(
    "span_masking",
    f"""WITH {USERS}, m AS (SELECT task_id, text || ' {CODE}' AS t FROM usr),
    s AS (SELECT task_id, t, regexp_extract_all(t, '{MASK_SQL}') AS spans FROM m)
    SELECT task_id, array_to_string(spans, '¦') AS spans, len(spans) AS n_spans, true AS lossless FROM s""",
)
def span_masking(spark, sf_dir):
    t = user_prompts(spark, sf_dir).select("task_id", F.concat("text", F.lit(" " + CODE)).alias("t"))
    m = t.withColumns({"found": L.mask_spans(F.col("t")), "masked": L.mask_text(F.col("t"))})
    return m.select(
        "task_id",
        F.array_join("found", "¦").alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        F.coalesce(L.unmask_text(F.col("masked"), F.col("found")) == F.col("t"), F.lit(False)).alias("lossless"),
    )


def guarded(spark, sf_dir):
    u = user_prompts(spark, sf_dir)
    candidates = F.array(
        F.struct(F.lit("g01").alias("candidate_id"), F.col("variant").alias("prompt")),
        F.struct(F.lit("g02").alias("candidate_id"), F.concat(F.lit("Now "), F.col("source")).alias("prompt")),
        F.struct(F.lit("g03").alias("candidate_id"), F.concat(F.lit("Not now. "), F.col("source"), F.lit("?")).alias("prompt")),
    )
    return V.surface_guards(u.select("task_id", "source", F.inline(candidates)), "source", "prompt")


@query("surface_guards")
def surface_guards(spark, sf_dir):
    return guarded(spark, sf_dir).select(
        "task_id", "candidate_id", F.array_join("failures", "|").alias("failures"), "passed", "length_ratio", "surface_similarity"
    )


@query("candidate_order")
def candidate_order(spark, sf_dir):
    return V.candidate_order(guarded(spark, sf_dir)).select("task_id", "candidate_id", "passed", "rank")


CANDIDATES = f"""{AUDIT}, cand AS (
  SELECT task_id, 'g01' AS candidate_id, variant AS prompt, passed FROM el UNION ALL
  SELECT task_id, 'g02', 'Now ' || source, turn % 4 <> 2 FROM el),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY NOT passed, candidate_id) = 1)"""


def candidates(spark, sf_dir):
    rows = audited(spark, sf_dir)
    return rows.select(
        "task_id",
        F.inline(
            F.array(
                F.struct(F.lit("g01").alias("candidate_id"), F.col("variant").alias("prompt"), F.col("passed").alias("passed")),
                F.struct(
                    F.lit("g02").alias("candidate_id"),
                    F.concat(F.lit("Now "), F.col("source")).alias("prompt"),
                    (F.col("turn") % 4 != 2).alias("passed"),
                ),
            )
        ),
    )


@query("candidate_selection", f"WITH {CANDIDATES} SELECT task_id, candidate_id, prompt, passed FROM best")
def candidate_selection(spark, sf_dir):
    return V.choose_candidate(candidates(spark, sf_dir), [F.col("candidate_id")])


@query(
    "formulation_routing",
    f"""WITH {CANDIDATES}, {SENT.replace(USERS + ",", "")},
    re AS (SELECT task_id, array_to_string(p, ' ') AS prompt FROM pp WHERE transformation IN ('context_to_end','parallel_action_rotation'))
    SELECT task_id, coalesce(re.prompt, best.prompt) AS prompt, CASE WHEN re.prompt IS NOT NULL THEN 'information_reordering' ELSE 'constrained_paraphrasing' END AS subtype,
      re.prompt IS NOT NULL OR best.passed AS strict_mt_eligible FROM usr LEFT JOIN re USING (task_id) LEFT JOIN best USING (task_id)""",
)
def formulation_routing(spark, sf_dir):
    reorder = permuted(spark, sf_dir).filter(
        F.col("transformation").isin("context_to_end", "parallel_action_rotation")
    ).select("task_id", F.array_join("permuted", " ").alias("prompt"))
    best = V.choose_candidate(candidates(spark, sf_dir), [F.col("candidate_id")])
    return V.route_formulation(user_prompts(spark, sf_dir), reorder, best)


@query(
    "paraphrase_summary",
    f"""WITH {CANDIDATES}, t AS (SELECT task_id, bool_or(passed) AS ok, count(*) AS n FROM cand GROUP BY ALL)
    SELECT substr(task_id, 1, 3) AS kind, count(*) AS tasks, count(*) FILTER (ok) AS tasks_with_passing_candidate, sum(n)::BIGINT AS candidates FROM t GROUP BY ALL""",
)
def paraphrase_summary(spark, sf_dir):
    per_task = candidates(spark, sf_dir).groupBy("task_id").agg(
        F.bool_or("passed").alias("ok"), F.count(F.lit(1)).alias("n")
    )
    return per_task.groupBy(F.substring("task_id", 1, 3).alias("kind")).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("ok").alias("tasks_with_passing_candidate"),
        F.sum("n").alias("candidates"),
    )


@query(
    "plan_completeness",
    f"""WITH {RENDERED}, c AS (SELECT task_id, count(*) AS forms, count(DISTINCT form) AS distinct_forms, count(prompt) AS prompts FROM tone GROUP BY ALL)
    SELECT task_id, forms, distinct_forms, prompts FROM c WHERE forms <> 15 OR distinct_forms <> forms OR prompts <> 15""",
)
def plan_completeness(spark, sf_dir):
    per_task = rendered(spark, sf_dir).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("forms"),
        F.count_distinct("form").alias("distinct_forms"),
        F.count("prompt").alias("prompts"),
    )
    return per_task.filter((F.col("forms") != 15) | (F.col("distinct_forms") != F.col("forms")) | (F.col("prompts") != 15))


@query(
    "ascii_ratio",
    "SELECT lang, count(*) AS n, round(avg(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) ELSE 1.0 END), 9) AS mean_ratio FROM documents GROUP BY ALL",
)
def ascii_ratio_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(ascii_ratio(F.col("text"))).alias("mean_ratio"))
