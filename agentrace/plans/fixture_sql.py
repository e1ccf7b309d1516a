"""SQL definitions of the execution logs derived from ``events``, for the oracle queries."""

BASE = """base AS (
  SELECT 'model_' || (user_id % 3) AS model,
         (['AIP-','ACB-','TJB-'])[(user_id // 3) % 3 + 1] || lpad(user_id::VARCHAR, 6, '0') AS task_id,
         CASE WHEN d // 3 = 0 THEN 'source' WHEN d // 3 <= 5 THEN 'tone'
              WHEN d // 3 <= 8 THEN 'multilingual' ELSE 'formulation' END AS family,
         (['source','p01','n01','i01','p02','n02','lang_zh','lang_fr','lang_de','formulation'])[d // 3 + 1] AS form,
         d % 3 AS repeat, user_id, event_id, event_type, value, k
  FROM (SELECT event_id, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CAST(day(ts) AS INTEGER) - 1 AS d FROM events)
)"""

DATASET = """CASE WHEN task_id LIKE 'AIP-%' THEN 'permission' WHEN task_id LIKE 'ACB-%' THEN 'sandbox' ELSE 'trajectory' END"""


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9._:/=-]+', '_', 'g'), '_')"


TOOL_OPS = f"""{BASE},
ops AS (
  SELECT model, task_id, family, form, repeat, user_id,
         row_number() OVER (PARTITION BY model, task_id, family, form, repeat ORDER BY event_id) - 1 AS op_ord,
         event_type AS tool, k % 5 AS arg,
         CASE WHEN value > 150 THEN 'coverage_gap' WHEN k % 10 = 9 THEN 'unknown' ELSE 'success' END AS outcome
  FROM base
)"""

TOOL_EDGES = f"""{TOOL_OPS},
edges AS (
  SELECT model, task_id, family, form, repeat, 'op:' || op_ord AS src, 'tool:' || tool AS dst, 'USES' AS relation FROM ops
  UNION ALL
  SELECT model, task_id, family, form, repeat, 'op:' || op_ord, 'argument:k=' || arg, 'HAS_ARGUMENT' FROM ops
  UNION ALL
  SELECT model, task_id, family, form, repeat, 'op:' || (op_ord - 1), 'op:' || op_ord, 'DIRECTLY_PRECEDES' FROM ops WHERE op_ord > 0
)"""

TOOL_GRAPH = f"""{TOOL_EDGES},
nodes AS (
  SELECT model, task_id, family, form, repeat, 'op:' || op_ord AS node_id, 'op:' || tool || '|outcome:' || outcome AS label FROM ops
  UNION ALL
  SELECT DISTINCT model, task_id, family, form, repeat, dst, dst FROM edges WHERE dst NOT LIKE 'op:%'
)"""


def wl_features(keys: str, nodes: str = "nodes", edges: str = "edges", suffix: str = "", cond: str = "TRUE") -> str:
    """CTEs up to ``feat{suffix}``: exact-string Weisfeiler-Lehman features with SHA-256 labels."""
    using = ", ".join(k.strip() for k in keys.split(","))

    def step(i: int) -> str:
        return f"""
nb{suffix}{i} AS (
  SELECT {using}, node_id, string_agg(s, '||' ORDER BY s) AS joined FROM (
    SELECT {using}, e.src AS node_id, 'OUT|' || relation || '|' || l.label AS s
    FROM ed{suffix} e JOIN lab{suffix}{i - 1} l USING ({using}) WHERE e.dst = l.node_id
    UNION ALL
    SELECT {using}, e.dst AS node_id, 'IN|' || relation || '|' || l.label AS s
    FROM ed{suffix} e JOIN lab{suffix}{i - 1} l USING ({using}) WHERE e.src = l.node_id)
  GROUP BY ALL),
lab{suffix}{i} AS (
  SELECT {using}, node_id, sha256(l.label || '||' || coalesce(joined, '')) AS label
  FROM lab{suffix}{i - 1} l LEFT JOIN nb{suffix}{i} USING ({using}, node_id))"""

    return f"""
ed{suffix} AS (SELECT * FROM {edges} WHERE {cond}),
lab{suffix}0 AS (SELECT {using}, node_id, label FROM {nodes}),{step(1)},{step(2)},
feat{suffix} AS (
  SELECT {using}, iteration, label AS feature, count(*) AS cnt FROM (
    SELECT {using}, 0 AS iteration, label FROM lab{suffix}0 UNION ALL
    SELECT {using}, 1, label FROM lab{suffix}1 UNION ALL
    SELECT {using}, 2, label FROM lab{suffix}2)
  GROUP BY ALL)"""


def pair_similarity(task_keys: str, runs: str = "runs", feat: str = "feat", suffix: str = "") -> str:
    """CTE ``pairs{suffix}`` over runs(task_keys, family, form, repeat) and features."""
    tk = task_keys
    tks = [k.strip() for k in tk.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in tks)
    return f"""
norm{suffix} AS (SELECT {tk}, family, form, repeat, sum(cnt * cnt)::DOUBLE AS n2 FROM {feat} GROUP BY ALL),
pr{suffix} AS (
  SELECT {", ".join("b." + k for k in tks)}, b.family, b.form, a.form AS left_form,
         CASE WHEN a.family <> b.family OR a.form <> b.form THEN 'source_variant'
              WHEN a.family = 'source' THEN 'source_internal' ELSE 'variant_internal' END AS comparison,
         a.repeat AS left_repeat, b.repeat AS right_repeat
  FROM {runs} a JOIN {runs} b ON {same}
   AND ((a.family = b.family AND a.form = b.form AND a.repeat < b.repeat)
        OR (a.family = 'source' AND b.family <> 'source'))),
dot{suffix} AS (
  SELECT {", ".join("p." + k for k in tks)}, p.family, p.form, comparison, left_repeat, right_repeat,
         sum(f.cnt * g.cnt)::DOUBLE AS d
  FROM pr{suffix} p
  JOIN {feat} f ON {" AND ".join(f"p.{k} = f.{k}" for k in tks)} AND p.left_form = f.form AND p.left_repeat = f.repeat
  JOIN {feat} g ON {" AND ".join(f"p.{k} = g.{k}" for k in tks)} AND p.form = g.form AND p.right_repeat = g.repeat
       AND f.iteration = g.iteration AND f.feature = g.feature
  GROUP BY ALL),
pairs{suffix} AS (
  SELECT {", ".join("p." + k for k in tks)}, p.family, p.form, p.comparison, p.left_repeat, p.right_repeat,
         CASE WHEN coalesce(x.n2, 0) = 0 AND coalesce(y.n2, 0) = 0 THEN 1.0
              WHEN coalesce(x.n2, 0) = 0 OR coalesce(y.n2, 0) = 0 THEN 0.0
              ELSE coalesce(d, 0) / sqrt(x.n2 * y.n2) END AS similarity
  FROM pr{suffix} p
  LEFT JOIN norm{suffix} x ON {" AND ".join(f"p.{k} = x.{k}" for k in tks)} AND p.left_form = x.form AND p.left_repeat = x.repeat
  LEFT JOIN norm{suffix} y ON {" AND ".join(f"p.{k} = y.{k}" for k in tks)} AND p.form = y.form AND p.right_repeat = y.repeat
  LEFT JOIN dot{suffix} d ON {" AND ".join(f"p.{k} = d.{k}" for k in tks)} AND p.family = d.family AND p.form = d.form
       AND p.comparison = d.comparison AND p.left_repeat = d.left_repeat AND p.right_repeat = d.right_repeat)"""


RUNS = "runs AS (SELECT DISTINCT model, task_id, family, form, repeat FROM base)"

PAIRS = (
    TOOL_GRAPH + "," + RUNS + "," + wl_features("model, task_id, family, form, repeat") + "," + pair_similarity("model, task_id")
)

VARIANTS = f"""{PAIRS},
per_form AS (
  SELECT model, task_id, family, form,
    avg(similarity) FILTER (comparison = 'source_internal') AS source_internal_mean,
    min(similarity) FILTER (comparison = 'source_internal') AS source_internal_min,
    max(similarity) FILTER (comparison = 'source_internal') AS source_internal_max,
    avg(similarity) FILTER (comparison = 'source_variant') AS source_variant_mean,
    min(similarity) FILTER (comparison = 'source_variant') AS source_variant_min,
    max(similarity) FILTER (comparison = 'source_variant') AS source_variant_max,
    avg(similarity) FILTER (comparison = 'variant_internal') AS variant_internal_mean,
    min(similarity) FILTER (comparison = 'variant_internal') AS variant_internal_min,
    max(similarity) FILTER (comparison = 'variant_internal') AS variant_internal_max,
    count(*) FILTER (comparison = 'source_variant') AS n_source_variant_pairs
  FROM pairs GROUP BY ALL),
variants AS (
  SELECT v.model, v.task_id, v.family, v.form, v.source_variant_mean, v.source_variant_min, v.source_variant_max,
         v.variant_internal_mean, v.variant_internal_min, v.variant_internal_max, v.n_source_variant_pairs,
         s.source_internal_mean, s.source_internal_min, s.source_internal_max,
         s.source_internal_mean - v.source_variant_mean AS delta_baseline_minus_variant
  FROM per_form v LEFT JOIN (SELECT * FROM per_form WHERE family = 'source') s USING (model, task_id)
  WHERE v.family <> 'source' AND v.source_variant_mean IS NOT NULL)"""

TASK_FAMILY = f"""{VARIANTS},
subs AS (
  SELECT *, 'all' AS subset FROM variants UNION ALL
  SELECT *, 'strict' FROM variants WHERE form NOT IN ('n02', 'lang_de')),
task_family AS (
  SELECT subset, model, task_id, family, count(*) AS variant_count,
         avg(source_internal_mean) AS source_internal_mean, avg(source_variant_mean) AS source_variant_mean,
         avg(variant_internal_mean) AS variant_internal_mean,
         avg(delta_baseline_minus_variant) AS delta_baseline_minus_variant
  FROM subs GROUP BY ALL)"""

SANDBOX_LOG = """log AS (
  SELECT model, task_id, family, form, repeat, user_id, event_id, k, event_type, value,
    CASE WHEN event_type = 'click' AND k % 6 = 5 THEN 'agent_tool_call'
         WHEN event_type = 'click' THEN 'tool_call'
         WHEN event_type = 'error' AND k % 3 = 0 THEN 'tool_error'
         WHEN event_type = 'error' THEN 'tool_result'
         WHEN event_type = 'signup' AND k % 4 <= 1 THEN 'permission_request'
         WHEN event_type = 'signup' AND k % 4 = 2 THEN 'permission_grant'
         WHEN event_type = 'signup' AND k % 8 = 7 THEN 'permission_deny'
         WHEN event_type = 'signup' THEN 'state_change'
         WHEN event_type = 'view' THEN 'access' ELSE 'disclosure' END AS type,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 4 = 3 THEN 'list_apps' ELSE 'Tool ' || (k % 4) END
         WHEN event_type = 'error' AND k % 3 <> 0 THEN 'Tool ' || (k % 3) END AS tool,
    CASE WHEN event_type IN ('signup','view') THEN 'app_' || ((k // 4) % 2) END AS app,
    CASE WHEN event_type = 'signup' AND k % 4 <= 1 THEN (['once','session','persistent'])[k % 3 + 1] END AS scope,
    CASE WHEN event_type = 'signup' AND k % 4 <= 2 THEN 'read'
         WHEN event_type = 'purchase' THEN (['send_message','add_todo'])[k % 2 + 1] END AS operation,
    CASE WHEN event_type = 'signup' AND k % 4 <= 2 AND k % 5 <> 0 THEN '/inbox' END AS pointer,
    CASE WHEN event_type = 'purchase' AND k % 7 <> 0 THEN 'r' || (k % 5)
         WHEN event_type = 'signup' AND k % 4 = 3 THEN 'd' || (k % 3) END AS destination,
    CASE WHEN event_type = 'purchase' AND k % 7 = 0 THEN 'R ' || (k % 3) END AS recipient,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 3 = 0 THEN ['f' || (k % 4), 'f' || (k % 5)] ELSE ['f' || (k % 4)] END END AS fields,
    CASE WHEN event_type = 'purchase' THEN 'Item ' || (k % 7) END AS payload,
    CASE WHEN event_type = 'signup' AND k % 4 = 2 AND k % 3 = 0 THEN 'sandbox_auto_grant' END AS authority,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 0 THEN 'error:oops_' || (k % 5) ELSE 'success' END
           WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'success' ELSE 'error:bad_code_' || (k % 5) END
           ELSE 'coverage_gap' END END AS res_status
  FROM base)"""

SEGMENTS = f"""{BASE}, {SANDBOX_LOG},
seg AS (
  SELECT *,
    sum(CASE WHEN type IN ('tool_call','agent_tool_call') THEN 1 ELSE 0 END) OVER w AS segment,
    sum(CASE WHEN type = 'tool_call' AND tool <> 'list_apps' THEN 1 ELSE 0 END) OVER w AS op_count,
    last_value(CASE WHEN type = 'tool_call' THEN tool END IGNORE NULLS) OVER w AS call_tool
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
act AS (
  SELECT *, CASE WHEN call_tool <> 'list_apps' THEN op_count - 1 END AS active_op FROM seg),
sops AS (
  SELECT c.user_id, c.segment, c.op_count - 1 AS op_ord, c.tool,
    coalesce((SELECT arg_min(r.res_status, r.event_id) FROM seg r
      WHERE r.user_id = c.user_id AND r.segment = c.segment AND r.event_id > c.event_id
        AND (r.type = 'tool_error' OR (r.type = 'tool_result' AND r.tool = c.tool))), 'unknown') AS outcome
  FROM seg c WHERE c.type = 'tool_call' AND c.tool <> 'list_apps')"""

DECISIONS = f"""{SEGMENTS},
dec AS (
  SELECT q.user_id, q.event_id, q.segment, q.active_op, q.app, q.operation, q.scope,
    coalesce((SELECT arg_min(CASE WHEN g.type = 'permission_deny' THEN 'denied'
                       WHEN g.authority = 'sandbox_auto_grant' THEN 'auto_granted' ELSE 'granted' END, g.event_id)
     FROM seg g WHERE g.user_id = q.user_id AND g.segment = q.segment AND g.event_id > q.event_id
       AND (g.type = 'permission_deny' OR (g.type = 'permission_grant'
            AND g.operation IS NOT DISTINCT FROM q.operation AND g.app IS NOT DISTINCT FROM q.app
            AND g.pointer IS NOT DISTINCT FROM q.pointer AND g.destination IS NOT DISTINCT FROM q.destination))),
     'not_granted') AS decision
  FROM act q WHERE q.type = 'permission_request')"""

SANDBOX_EDGES = f"""{DECISIONS},
sedges AS (
  SELECT user_id, 'op:' || op_ord AS src, 'tool:' || {slug("tool")} AS dst, 'USES' AS relation FROM sops
  UNION ALL SELECT user_id, 'op:' || (op_ord - 1), 'op:' || op_ord, 'DIRECTLY_PRECEDES' FROM sops WHERE op_ord > 0
  UNION ALL SELECT user_id, 'op:' || active_op, 'resource:' || app, 'REQUESTS:read|scope=' || scope || '|decision=' || decision
    FROM dec WHERE active_op IS NOT NULL
  UNION ALL SELECT user_id, 'op:' || active_op, 'resource:' || app, 'ACCESSES' FROM act WHERE type = 'access' AND active_op IS NOT NULL
  UNION ALL SELECT user_id, 'op:' || active_op, 'field:' || app || ':' || f, 'READS'
    FROM (SELECT user_id, active_op, app, unnest(fields) AS f FROM act WHERE type = 'access' AND active_op IS NOT NULL)
  UNION ALL SELECT user_id, 'op:' || active_op, 'recipient:' || {slug("coalesce(destination, recipient)")}, 'DISCLOSES_TO'
    FROM act WHERE type = 'disclosure' AND active_op IS NOT NULL
  UNION ALL SELECT user_id, 'op:' || active_op, 'output:' || operation, 'HAS_OUTPUT' FROM act WHERE type = 'disclosure' AND active_op IS NOT NULL
  UNION ALL SELECT user_id, 'op:' || active_op, 'state:' || app || ':' || destination, 'CHANGES_STATE'
    FROM act WHERE type = 'state_change' AND active_op IS NOT NULL),
snodes AS (
  SELECT user_id, 'op:' || op_ord AS node_id, 'op:' || {slug("tool")} || '|outcome:' || outcome AS label FROM sops
  UNION ALL SELECT DISTINCT user_id, dst, dst FROM sedges WHERE dst NOT LIKE 'op:%')"""
