"""Queries over the library of recorded tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.operators import library as LB
from agentrace.plans.registry import query
from agentrace.session import materialize, new_folder
from agentrace.sources import readers
from agentrace.sources.tables import pick, table

# Tools come from ``part`` (one published record per row), recorded calls from ``lineitem``.
TOOLS = """tools AS (SELECT p_brand AS domain, 'pt' || (p_size % 5) AS parent_tool, 'api' || (p_partkey % 7) AS api,
  'tool ' || (p_partkey % 7) AS tool_name, CASE WHEN p_partkey % 11 = 0 THEN 'int' ELSE 'str' END AS shape, (p_size % 2)::VARCHAR AS "default",
  p_name AS description, p_partkey AS record FROM part)"""
CALLS = """calls AS (SELECT l_orderkey * 8 + l_linenumber AS call_id, l_orderkey, l_linenumber, 'tool ' || (l_partkey % 7) AS tool_name, 'Brand#' || (l_suppkey % 5 + 1) || (l_partkey % 5 + 1) AS domain,
  CASE WHEN l_partkey % 3 = 0 THEN 'pt' || (l_partkey % 5) END AS parent_tool,
  '{"qty": ' || l_quantity::INTEGER || ', "unit": "' || l_returnflag || '"}' AS args, CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Error: bad' WHEN 3 THEN '{"error": "x"}'
    WHEN 4 THEN '{"error": null, "v": "' || l_linestatus || '"}' ELSE l_linestatus || (l_orderkey % 2) END AS output,
  CASE WHEN l_orderkey % 10 = 7 THEN 'FAILED' WHEN l_orderkey % 10 = 6 THEN 'Success' END AS status FROM lineitem),
us AS (SELECT *, l_orderkey % 9 NOT IN (0, 1, 2, 3) AND coalesce(status, '') <> 'FAILED' AS usable FROM calls)"""


def tools_table(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.col("p_brand").alias("domain"),
        F.concat(F.lit("pt"), (size % 5).cast("string")).alias("parent_tool"),
        F.concat(F.lit("api"), (key % 7).cast("string")).alias("api"),
        F.concat(F.lit("tool "), (key % 7).cast("string")).alias("tool_name"),
        F.when(key % 11 == 0, "int").otherwise("str").alias("shape"),
        (size % 2).cast("string").alias("default"),
        F.col("p_name").alias("description"),
        key.alias("record"),
    )


def calls_table(spark, sf_dir, *more: Column) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    required = F.array(F.struct(F.lit("unit").alias("name"), F.lit("0").alias("value")))
    optional = F.array(
        F.struct(F.lit("unit").alias("name"), F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"')).alias("value")),
        F.struct(F.lit("qty").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value")),
    )
    output = (
        F.when(order % 9 == 0, None)
        .when(order % 9 == 1, "  ")
        .when(order % 9 == 2, "Error: bad")
        .when(order % 9 == 3, '{"error": "x"}')
        .when(order % 9 == 4, F.concat(F.lit('{"error": null, "v": "'), F.col("l_linestatus"), F.lit('"}')))
        .otherwise(F.concat("l_linestatus", (order % 2).cast("string")))
    )
    return li.select(
        (order * 8 + F.col("l_linenumber")).alias("call_id"),
        F.col("l_orderkey"),
        F.concat(F.lit("tool "), (part % 7).cast("string")).alias("tool_name"),
        F.concat(
            F.lit("Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), (part % 5 + 1).cast("string")
        ).alias("domain"),
        F.when(part % 3 == 0, F.concat(F.lit("pt"), (part % 5).cast("string"))).alias("parent_tool"),
        LB.canonical_map(LB.flat_parameters(required, optional)).alias("args"),
        output.alias("output"),
        F.when(order % 10 == 7, "FAILED").when(order % 10 == 6, "Success").alias("status"),
        *more,
    ).withColumn("usable", LB.usable_response(F.col("output"), F.col("status")))


@query("usable_responses", f"WITH {CALLS} SELECT usable, status, output, count(*) AS n FROM us GROUP BY ALL")
def usable_responses(spark, sf_dir):
    return calls_table(spark, sf_dir).groupBy("usable", "status", "output").agg(F.count(F.lit(1)).alias("n"))


ROUTES = f"""{TOOLS}, routes AS (SELECT domain, parent_tool, api, count(*) AS n_records, min(shape) <> max(shape) AS ambiguous, min(record) AS record,
  min("default") <> max("default") AS default_dropped, min(tool_name) AS first_alias FROM tools GROUP BY ALL)"""


def routes(spark, sf_dir):
    return LB.schema_routes(tools_table(spark, sf_dir), ["domain", "parent_tool", "api"])


@query("schema_conflicts", f"WITH {ROUTES} SELECT * FROM routes")
def schema_conflicts(spark, sf_dir):
    return routes(spark, sf_dir)


RESOLVED = f"""{ROUTES}, {CALLS},
al AS (SELECT domain, parent_tool, domain || '/' || parent_tool || '/' || api AS tool_id, first_alias AS tool_name FROM routes WHERE NOT ambiguous),
sg AS (SELECT DISTINCT tool_name, domain, parent_tool FROM us),
opt AS (SELECT c.tool_name, c.domain, c.parent_tool, a.domain AS ad, a.tool_id FROM sg c JOIN al a USING (tool_name) WHERE c.parent_tool IS NULL OR c.parent_tool = a.parent_tool),
ag AS (SELECT tool_name, domain, parent_tool, count(*) AS n, count(*) FILTER (ad = domain) AS nd, min(tool_id) AS any_t, min(tool_id) FILTER (ad = domain) AS own_t FROM opt GROUP BY ALL),
rs AS (SELECT c.*, CASE WHEN nd = 1 THEN own_t WHEN nd = 0 AND n = 1 THEN any_t END AS tool_id
  FROM us c LEFT JOIN ag ON c.tool_name = ag.tool_name AND c.domain = ag.domain AND c.parent_tool IS NOT DISTINCT FROM ag.parent_tool)"""


def resolved(spark, sf_dir):
    aliases = routes(spark, sf_dir).filter(~F.col("ambiguous")).select(
        "domain",
        "parent_tool",
        F.concat_ws("/", "domain", "parent_tool", "api").alias("tool_id"),
        F.col("first_alias").alias("tool_name"),
    )
    return LB.resolve_schemas(calls_table(spark, sf_dir), aliases)


@query("schema_resolution", f"WITH {RESOLVED} SELECT tool_name, domain, parent_tool, tool_id, count(*) AS n FROM rs GROUP BY ALL")
def schema_resolution(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("tool_name", "domain", "parent_tool", "tool_id").agg(
        F.count(F.lit(1)).alias("n")
    )


# Several APIs share a name; some calls name the API, some a domain, which may be another than their own.
ATTRIBUTES = f"""{ROUTES},
al AS (SELECT domain, parent_tool, api, domain || '/' || parent_tool || '/' || api AS tool_id, 'tool ' || (substr(api, 4)::INTEGER % 3) AS tool_name FROM routes WHERE NOT ambiguous),
ac AS (SELECT 'tool ' || ((l_partkey % 7) % 3) AS tool_name, 'Brand#' || (l_suppkey % 6 + 1) || (l_partkey % 6 + 1) AS domain,
  CASE WHEN l_partkey % 3 = 0 THEN 'pt' || (l_partkey % 5) WHEN l_partkey % 3 = 1 THEN '' END AS parent_tool,
  CASE WHEN l_orderkey % 2 = 0 THEN 'api' || (l_partkey % 7) END AS api,
  CASE WHEN l_orderkey % 5 = 1 THEN 'Brand#' || (l_suppkey % 6 + 1) || (l_partkey % 6 + 1) WHEN l_orderkey % 5 = 2 THEN 'Brand#11' WHEN l_orderkey % 5 = 3 THEN '' END AS tool_domain FROM lineitem),
sg AS (SELECT *, count(*) AS n FROM ac GROUP BY ALL),
ok AS (SELECT sg.*, al.domain AS ad, al.tool_id FROM sg LEFT JOIN al ON sg.tool_name = al.tool_name AND coalesce(sg.parent_tool, '') IN ('', al.parent_tool)
  AND coalesce(sg.api, '') IN ('', al.api) AND coalesce(sg.tool_domain, '') IN ('', al.domain)),
ch AS (SELECT tool_name, domain, parent_tool, api, tool_domain, n, count(tool_id) AS n_all, count(*) FILTER (ad = domain) AS n_own, min(tool_id) AS t_all, min(tool_id) FILTER (ad = domain) AS t_own FROM ok GROUP BY ALL)"""


@query(
    "schema_resolution_by_attributes",
    f"""WITH {ATTRIBUTES} SELECT tool_name, domain, parent_tool, api, tool_domain, n, CASE WHEN n_own = 1 THEN t_own WHEN n_own = 0 AND n_all = 1 THEN t_all END AS tool_id FROM ch""",
)
def schema_resolution_by_attributes(spark, sf_dir):
    """Calls that may name parent tool, API and domain, resolved once per combination of names."""
    aliases = routes(spark, sf_dir).filter(~F.col("ambiguous")).select(
        "domain",
        "parent_tool",
        "api",
        F.concat_ws("/", "domain", "parent_tool", "api").alias("tool_id"),
        F.concat(F.lit("tool "), (F.substring("api", 4, 9).cast("int") % 3).cast("string")).alias("tool_name"),
    )
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    domain = F.concat(text("Brand#", F.col("l_suppkey") % 6 + 1), (part % 6 + 1).cast("string"))
    calls = table(spark, sf_dir, "lineitem").select(
        text("tool ", (part % 7) % 3).alias("tool_name"),
        domain.alias("domain"),
        F.when(part % 3 == 0, text("pt", part % 5)).when(part % 3 == 1, "").alias("parent_tool"),
        F.when(order % 2 == 0, text("api", part % 7)).alias("api"),
        F.when(order % 5 == 1, domain).when(order % 5 == 2, "Brand#11").when(order % 5 == 3, "").alias("tool_domain"),
    )
    return LB.resolve_schemas(calls.groupBy(*calls.columns).agg(F.count(F.lit(1)).alias("n")), aliases)


@query(
    "library_manifest",
    f"""WITH {RESOLVED} SELECT count(*) AS observed_calls, count(*) FILTER (NOT usable) AS excluded_missing_or_error_response,
    count(*) FILTER (usable AND tool_id IS NULL) AS unresolved_tool_schema, count(*) FILTER (usable AND tool_id IS NOT NULL) AS accepted_observations FROM rs""",
)
def library_manifest(spark, sf_dir):
    return LB.manifest_counters(resolved(spark, sf_dir))


MODE = f"""{CALLS}, kc AS (SELECT sha256('{{"arguments": ' || args || ', "tool_id": "' || tool_name || '"}}') AS call_key, sha256(output) AS response_hash, output AS response, count(*) AS n FROM us WHERE usable GROUP BY ALL),
mode AS (SELECT call_key, response, response_hash, n, count(*) OVER (PARTITION BY call_key) AS alternatives, sum(n) OVER (PARTITION BY call_key)::BIGINT AS observations
  FROM kc QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY n DESC, response_hash) = 1)"""


def keyed(calls: DataFrame) -> DataFrame:
    return calls.withColumn("call_key", LB.call_key(F.col("tool_name"), F.col("args")))


def library(spark, sf_dir):
    ok = keyed(calls_table(spark, sf_dir).filter("usable"))
    return LB.response_mode(ok.withColumnRenamed("output", "response"))


@query("response_mode", f"WITH {MODE} SELECT *, alternatives > 1 AS conflicting FROM mode")
def response_mode(spark, sf_dir):
    return library(spark, sf_dir)


@query(
    "call_lookup",
    f"""WITH {MODE}, rq AS (SELECT call_id, sha256('{{"arguments": ' || CASE WHEN call_id % 4 = 0 THEN replace(args, '"qty": ', '"qty": 9') ELSE args END || ', "tool_id": "' || tool_name || '"}}') AS call_key FROM us)
    SELECT call_id, response, response IS NULL AS coverage_gap FROM rq LEFT JOIN mode USING (call_key)""",
)
def call_lookup(spark, sf_dir):
    calls = calls_table(spark, sf_dir)
    asked = F.when(
        F.col("call_id") % 4 == 0, F.replace(F.col("args"), F.lit('"qty": '), F.lit('"qty": 9'))
    ).otherwise(F.col("args"))
    requests = keyed(calls.withColumn("args", asked)).select("call_id", "call_key")
    return LB.lookup_calls(requests, library(spark, sf_dir)).select("call_id", "response", "coverage_gap")


TOK = r"regexp_extract_all(lower({x}), '-?[0-9]+(?:\.[0-9]+)?|[\p{{L}}\p{{N}}]+')"
SEARCH = f"""{TOOLS}, q AS (SELECT record AS query_id, description AS query FROM tools),
ix AS (SELECT DISTINCT record, unnest({TOK.format(x="tool_name || ' ' || description || ' ' || domain")}) AS token FROM tools),
w AS (SELECT DISTINCT query_id, unnest({TOK.format(x="query")}) AS token FROM q),
m AS (SELECT query_id, record FROM ix JOIN w USING (token) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM w w2 WHERE w2.query_id = w.query_id))"""


@query("token_search", f"WITH {SEARCH.replace('HAVING count(*) = (SELECT count(*) FROM w w2 WHERE w2.query_id = w.query_id)', 'HAVING count(*) = any_value(need)').replace('FROM ix JOIN w USING (token) GROUP BY ALL', 'FROM ix JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS need FROM w) w USING (token) GROUP BY query_id, record')} SELECT * FROM m")
def token_search(spark, sf_dir):
    """Every tool description is searched in the names and descriptions of all tools."""
    tools = tools_table(spark, sf_dir)
    text = tools.select("record", F.concat_ws(" ", "tool_name", "description", "domain").alias("text"))
    queries = tools.select(
        F.col("record").alias("query_id"), F.col("description").alias("query")
    )
    return LB.token_search(text, queries, "record", "text")


@query(
    "search_page",
    f"""WITH {TOOLS}, m AS (SELECT tool_name, record, description, count(*) OVER () AS total, row_number() OVER (ORDER BY tool_name, record) AS position FROM tools WHERE list_contains({TOK.format(x="domain")}, 'brand'))
    SELECT tool_name, record, description, position, total FROM m WHERE position > 15 AND position <= 30""",
)
def search_page(spark, sf_dir):
    tools = tools_table(spark, sf_dir).filter(F.array_contains(LB.search_tokens(F.col("domain")), "brand"))
    return LB.search_page(tools.select("tool_name", "record", "description"), ["tool_name", "record"], 15, 15)


# Each part is a tool, its lines' distinct arguments are calls of it; every 13th order's calls have no arguments. Each name is asked
# for with a quantity or none, each size as a quantity, with a flag, of any tool.
ASKED = f"""tl AS MATERIALIZED (SELECT p_partkey AS tool_id, {TOK.format(x="'tool ' || (p_partkey % 7) || ' ' || p_name")} AS words FROM part),
cl AS MATERIALIZED (SELECT *, sha256('{{"arguments": ' || arguments || ', "tool_id": "' || tool_id || '"}}') AS call_id, {TOK.format(x="arguments")} AS words FROM (
  SELECT DISTINCT l_partkey AS tool_id, CASE WHEN l_orderkey % 13 = 0 THEN '{{}}' ELSE '{{"qty": ' || l_quantity::INTEGER || ', "unit": "' || l_returnflag || '"}}' END AS arguments FROM lineitem)),
q AS MATERIALIZED (SELECT query_id, {TOK.format(x="coalesce(query, '')")} AS named, {TOK.format(x="argument_query")} AS wanted FROM (
  SELECT 'n' || p_name AS query_id, p_name AS query, CASE WHEN min(p_size) % 3 = 0 THEN '' ELSE min(p_size) || ' QTY' END AS argument_query FROM part GROUP BY p_name
  UNION ALL SELECT DISTINCT 's' || p_size, NULL, p_size || ' r' FROM part)),
qt AS MATERIALIZED (SELECT query_id, tool_id, wanted FROM q JOIN tl ON list_has_all(tl.words, named)),
found AS (SELECT query_id, call_id, tool_id, arguments FROM qt JOIN cl USING (tool_id) WHERE arguments = '{{}}' OR list_has_all(cl.words, wanted))"""


def call_id() -> Column:
    return LB.call_key(F.col("tool_id").cast("string"), F.col("arguments"))


def asked_library(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tools, their recorded calls, whose id is a ``call_id()``, and two-field queries, from parts and lines."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    part = table(spark, sf_dir, "part")
    tools = part.select(
        key.alias("tool_id"), F.concat_ws(" ", F.lit("tool"), (key % 7).cast("string"), "p_name").alias("text")
    )
    arguments = F.when(F.col("l_orderkey") % 13 == 0, "{}").otherwise(F.col("args")).alias("arguments")
    calls = (
        calls_table(spark, sf_dir, F.col("l_partkey").alias("tool_id"))
        .select("tool_id", arguments)
        .distinct()
    )
    least = F.min("p_size")
    of_name = part.groupBy("p_name").agg(
        F.when(least % 3 == 0, "").otherwise(F.concat(least.cast("string"), F.lit(" QTY"))).alias("argument_query")
    ).select(F.concat(F.lit("n"), "p_name").alias("query_id"), F.col("p_name").alias("query"), "argument_query")
    of_size = part.select("p_size").distinct().select(
        F.concat(F.lit("s"), size).alias("query_id"),
        F.lit(None).cast("string").alias("query"),
        F.concat(size, F.lit(" r")).alias("argument_query"),
    )
    return tools, calls, of_name.unionByName(of_size)


@query("call_argument_search", f"WITH {ASKED} SELECT query_id, call_id FROM found")
def call_argument_search(spark, sf_dir):
    return LB.call_search(*asked_library(spark, sf_dir), call_id=call_id())


@query(
    "call_argument_page",
    f"""WITH {ASKED}, one AS (SELECT arguments, call_id, tool_id FROM found WHERE query_id = 's7')
    SELECT *, row_number() OVER (ORDER BY arguments, call_id) AS position, count(*) OVER () AS total FROM one
    QUALIFY position > 30 AND position <= 60""",
)
def call_argument_page(spark, sf_dir):
    """The second page of thirty calls that a query finds, by their arguments."""
    tools, calls, queries = asked_library(spark, sf_dir)
    one = queries.filter("query_id = 's7'")
    found = LB.call_search(tools, calls, one, call_id=call_id(), keep=["arguments", "tool_id"])
    matches = materialize(found.select("arguments", "call_id", "tool_id"), "found")
    return LB.search_page(matches, ["arguments", "call_id"], 30, 30)


@query(
    "reference_overlap",
    f"""WITH {CALLS}, e AS (SELECT l_orderkey, tool_name || args AS item, count(*) AS e FROM us WHERE l_linenumber <= 4 GROUP BY ALL),
    a AS (SELECT l_orderkey, tool_name || args AS item, count(*) AS a FROM us WHERE l_linenumber >= 3 GROUP BY ALL),
    j AS (SELECT l_orderkey, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a USING (l_orderkey, item))
    SELECT l_orderkey, sum(e)::BIGINT AS expected, sum(least(e, a))::BIGINT AS matched, sum(greatest(a - e, 0))::BIGINT AS extra, sum(greatest(e - a, 0))::BIGINT AS missing FROM j GROUP BY ALL""",
)
def reference_overlap(spark, sf_dir):
    calls = calls_table(spark, sf_dir).select(
        "l_orderkey", "call_id", F.concat("tool_name", "args").alias("item")
    )
    line = F.col("call_id") - F.col("l_orderkey") * 8
    return LB.reference_overlap(calls.filter(line <= 4), calls.filter(line >= 3), ["l_orderkey"], "item")


STATE = """st AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders)"""


@query(
    "json_leaves",
    f"""WITH {STATE} SELECT o_orderkey, '/status' AS pointer, '"' || o_orderstatus || '"' AS value FROM st
    UNION ALL SELECT o_orderkey, '/owner~1id/k~0ey', o_custkey::VARCHAR FROM st
    UNION ALL SELECT o_orderkey, '/items/0/prio', '"' || o_orderpriority || '"' FROM st
    UNION ALL SELECT o_orderkey, '/items/1', 'true' FROM st""",
)
def json_leaves(spark, sf_dir):
    """Leaves of nested states built from orders, with escaped pointer parts."""
    from agentrace.functions.jsontree import leaves

    o = table(spark, sf_dir, "orders")
    doc = F.concat(
        F.lit('{"status":"'), F.col("o_orderstatus"),
        F.lit('","owner/id":{"k~ey":'), F.col("o_custkey").cast("string"),
        F.lit('},"items":[{"prio":"'), F.col("o_orderpriority"), F.lit('"},true]}'),
    )
    return leaves(o.select("o_orderkey", doc.alias("doc")), "doc", ["o_orderkey"])


@query(
    "pointer_resolution",
    "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL",
)
def pointer_resolution(spark, sf_dir):
    from agentrace.functions.jsontree import resolve_pointer

    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.array(F.lit("x"), F.col("o_orderpriority")).alias("a b")))
    return o.select(resolve_pointer(doc, "/a b/1").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_json",
    "SELECT o_orderkey, '{\"a\":[1,{\"x\":' || o_custkey || ',\"y\":null}],\"b\":\"' || o_orderstatus || '\"}' AS canonical FROM orders",
)
def canonical_json(spark, sf_dir):
    from agentrace.functions.jsontree import canonical

    o = table(spark, sf_dir, "orders")
    doc = F.concat(
        F.lit('{ "b" : "'), F.col("o_orderstatus"), F.lit('", "a" : [1, {"y": null, "x": '),
        F.col("o_custkey").cast("string"), F.lit("}]}"),
    )
    return o.select("o_orderkey", canonical(doc).alias("canonical"))


@query(
    "tool_names_from_text",
    """SELECT t, count(*) AS n FROM (SELECT unnest(['tool ' || (p_partkey % 7), p_brand]) AS t FROM part) GROUP BY ALL""",
)
def tool_names_from_text(spark, sf_dir):
    """Tool names out of lists that were stored as text, with either quote style."""
    from agentrace.sources.readers import tool_names

    p = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("[{'tool name': 'tool "), (F.col("p_partkey") % 7).cast("string"),
        F.lit("', 'x': 1}, {'tool name': \""), F.col("p_brand"), F.lit("\"}]"),
    )
    names = tool_names(F.lit(None).cast("array<struct<name:string>>"), text)
    return p.select(F.explode(names).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query(
    "field_catalog",
    "SELECT p_brand, count(DISTINCT trim(x)) AS n FROM (SELECT p_brand, unnest(string_split(p_name || ', ' || p_type || ' ,, ', ',')) AS x FROM part) WHERE trim(x) <> '' GROUP BY ALL",
)
def field_catalog(spark, sf_dir):
    from agentrace.functions.text import comma_list

    p = table(spark, sf_dir, "part")
    fields = comma_list(F.concat_ws(", ", "p_name", F.concat("p_type", F.lit(" ,, "))))
    return p.select("p_brand", F.explode(fields).alias("x")).groupBy("p_brand").agg(F.count_distinct("x").alias("n"))


@query(
    "task_id_builder",
    f"WITH {CALLS} SELECT (['AIP','ACB','TJB'])[l_orderkey % 3 + 1] || '-' || lpad(l_linenumber::VARCHAR, 3, '0') AS task_id, count(*) AS n FROM calls GROUP BY ALL",
)
def task_id_builder(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    prefix = pick(("AIP", "ACB", "TJB"), (F.col("l_orderkey") % 3).cast("int"))
    return li.select(F.format_string("%s-%03d", prefix, "l_linenumber").alias("task_id")).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n")
    )


# An archive of traces, written from ``lineitem``: a record an order, a file per mode, slice and domain.
# Some records are no object or have no tool list; they count as rows and give no call.
TRACES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS tool_index FROM lineitem),
od AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey % 2, l_orderkey % 5, l_orderkey % 3 ORDER BY l_orderkey) - 1 AS "row" FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
tr AS (SELECT CASE l_orderkey % 2 WHEN 0 THEN 'parallel' ELSE 'sequential' END AS mode, l_orderkey % 5 AS slice, 'Domain ' || (l_orderkey % 3) AS domain, "row", tool_index,
  'tool ' || (l_partkey % 7) AS tool_name, CASE WHEN l_partkey % 3 = 0 THEN 'pt' || (l_partkey % 5) END AS parent_tool, 'api' || (l_suppkey % 4) AS api,
  '{"qty": ' || l_quantity::INTEGER || ', "unit": "' || l_returnflag || '"}' AS args,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'said "' || l_linestatus || '"' ELSE '{"v":' || l_suppkey || '}' END AS output, CASE WHEN l_linenumber % 2 = 0 THEN 'Success' END AS status
  FROM li JOIN od USING (l_orderkey) WHERE l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0)"""


def trace_archive(spark, sf_dir) -> str:
    li = table(spark, sf_dir, "lineitem")
    part, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    text = lambda c: c.cast("string")
    quoted = F.to_json(F.struct(F.concat(F.lit('said "'), "l_linestatus", F.lit('"')).alias("executed_output")))
    nested = F.concat(F.lit('{"executed_output":{"v":'), text(F.col("l_suppkey")), F.lit("}}"))
    rest = F.struct(
        F.concat(F.lit("tool "), text(part % 7)).alias("tool name"),
        F.when(part % 3 == 0, F.concat(F.lit("pt"), text(part % 5))).alias("parent tool name"),
        F.concat(F.lit("api"), text(F.col("l_suppkey") % 4)).alias("API name"),
        F.when(line % 2 == 0, "Success").alias("execution_status"),
        F.array(F.struct(F.lit("unit").alias("name"), F.col("l_returnflag").alias("value"))).alias("required parameters"),
        F.array(F.struct(F.lit("qty").alias("name"), F.col("l_quantity").cast("int").alias("value"))).alias("optional parameters"),
    )
    output = F.when(line % 3 == 0, '{"executed_output":null}').when(line % 3 == 1, quoted).otherwise(nested)
    tool = F.concat(F.expr("left(_o, length(_o) - 1)"), F.lit(","), F.expr("substring(_j, 2)"))
    calls = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("_at"), output.alias("_o"), F.to_json(rest).alias("_j"))
    records = calls.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("_at", tool.alias("tool")))).alias("_t"))
    listed = F.concat(F.lit('{"tool list":['), F.array_join(F.transform("_t", lambda t: t["tool"]), ","), F.lit("]}"))
    value = F.when(order % 17 == 0, "7").when(order % 19 == 0, '{"tool list":"none"}').otherwise(listed)
    place = {
        "mode": F.when(order % 2 == 0, "parallel").otherwise("sequential"),
        "slice": order % 5,
        "domain": F.concat(F.lit("Domain "), text(order % 3)),
    }
    folder = new_folder(spark, "traces")
    rows = records.select("l_orderkey", value.alias("value")).withColumns(place)
    files = rows.repartition(*place).sortWithinPartitions(*place, "l_orderkey").drop("l_orderkey")
    files.write.partitionBy(*place).text(folder)
    return folder


@query("trace_calls", f"""WITH {TRACES} SELECT * FROM tr""")
def trace_calls(spark, sf_dir):
    """Calls of an archive with mode and slice from the path, and the record and place in it."""
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]+)/", 1)
    of_file = {"mode": part("mode"), "slice": part("slice").cast("long")}
    return readers.tool_traces(spark, trace_archive(spark, sf_dir), of_file).select(
        "mode", "slice", "domain", "row", "tool_index",
        "tool_name", "parent_tool", "api", "args", "output", "status",
    )
