"""Readers of run archives, manifests, annotations, judge results, trials and corpora."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "type string, tool string, tool_id string, tool_name string, app string, field string, scope string, "
    "operation string, pointer string, destination string, recipient string, fields array<string>, "
    "payload string, authority string, error string, status string"
)
RESULT = (
    "status string, final_response string, tool_calls int, elapsed_seconds double, clarification_rounds int, "
    "usage array<struct<input_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>,output_tokens:bigint>>"
)
GRAPH = (
    "name string, nodes array<struct<id:string,label:string>>, "
    "edges array<struct<source:string,target:string,label:string>>"
)
MANIFEST = (
    "model string, repeats int, episodes array<struct<task_id:string,family:string,form:string,prompt:string,"
    "tone:string,language:string,subtype:string,strict_mt_eligible:boolean>>"
)
JUDGE = (
    "job_id string, kind string, model_id string, task_id string, family string, parsed struct<"
    "scores:array<int>,variants:array<struct<form:string,source_variant_scores:array<int>,"
    "variant_internal_scores:array<int>,reason:string>>>"
)
VERDICT = "execution string, leaked_items array<string>, missing_items array<string>"
SUITE = (
    "task_id string, scenario_id string, status string, variants array<struct<id:string,prompt:string,"
    "tone:string,transformation:string,context_sensitive:boolean,eligible_pilot:boolean>>"
)
RUN_PATH = r"(?:^|/)([^/]+)/([^/]+)/([^/]+)__([^/]+)/r([0-9]+)/([^/]+)$"


def run_archive(spark: SparkSession, path: str) -> DataFrame:
    """Files of a packed archive (JSON lines of path and content) with their run keys.

    Archives are read in place: gzip files are one task each, so they spread by file.
    """
    files = spark.read.schema("path string, content string").json(path)
    part = lambda i: F.regexp_extract("path", RUN_PATH, i)
    return files.select(
        "path",
        part(1).alias("model"),
        part(2).alias("task_id"),
        part(3).alias("family"),
        part(4).alias("form"),
        part(5).try_cast("int").alias("repeat"),
        part(6).alias("file"),
        "content",
    ).filter(F.col("repeat").isNotNull())


RUN = ("model", "task_id", "family", "form", "repeat")


def event_log(archive: DataFrame) -> DataFrame:
    """Events in log order; blank lines are skipped and the position becomes ``event_id``."""
    lines = archive.filter(F.col("file") == "events.jsonl").select(
        *RUN, F.posexplode(F.split("content", "\r?\n")).alias("event_id", "line")
    )
    return (
        lines.filter(F.btrim("line") != "")
        .withColumn("e", F.from_json("line", EVENT))
        .select(
            *RUN,
            F.col("event_id").cast("long").alias("event_id"),
            "e.*",
            F.get_json_object("line", "$.arguments").alias("arguments"),
            F.get_json_object("line", "$.result").alias("result"),
        )
    )


def run_results(archive: DataFrame) -> DataFrame:
    """Readable results; an unreadable result drops its execution."""
    return (
        archive.filter(F.col("file") == "result.json")
        .select(*RUN, F.from_json("content", RESULT).alias("r"))
        .filter(F.col("r.status").isNotNull())
        .select(*RUN, "r.*")
    )


def operation_graphs(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of stored graphs in long form."""
    g = archive.filter(F.col("file") == "operation_graph.json").select(
        *RUN, F.from_json("content", GRAPH).alias("g")
    )
    nodes = g.select(*RUN, F.inline("g.nodes")).withColumnRenamed("id", "node_id")
    edges = g.select(*RUN, F.inline("g.edges")).select(
        *RUN, F.col("source").alias("src"), F.col("target").alias("dst"), F.col("label").alias("relation")
    )
    return nodes, edges


def manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return m.select("model", "repeats", F.inline("episodes")).withColumn(
        "strict_mt_eligible", F.coalesce("strict_mt_eligible", F.lit(True))
    )


def tool_names(listed: Column, text: Column) -> Column:
    """Tool names from a list, or from the text of a list with single or double quotes."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"'tool name': (?:'[^']*'|\"[^\"]*\")"), F.lit(0)),
        lambda m: F.regexp_extract(m, r"^'tool name': ['\"](.*)['\"]$", 1),
    )
    return F.coalesce(F.transform(listed, lambda t: t["name"]), found)


def annotations(permission: DataFrame, sandbox: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Task annotations of three sources in one table; columns a source lacks are NULL."""
    from agentrace.functions.text import comma_list, squash

    a = permission.select(
        F.format_string("AIP-%03d", "id").alias("task_id"),
        F.transform("datatype", squash).alias("needed"),
        F.transform(comma_list(F.coalesce("data_incorrect", F.lit(""))), squash).alias("unneeded"),
    )
    b = sandbox.select(
        F.concat(F.lit("ACB-"), F.col("scenario_id")).alias("task_id"),
        F.col("ground_truth.must_share").alias("must_share"),
        F.col("ground_truth.must_not_share").alias("must_not_share"),
    )
    c = trajectory.select(
        F.concat_ws(
            "-", F.lit("TJB"), "domain", F.when(F.col("mode") == "parallel", "P").otherwise("S"),
            F.col("targetCount").cast("string"), F.col("sourceRow").cast("string"),
        ).alias("task_id"),
        tool_names(F.col("tools"), F.col("tools_text")).alias("ref_tools"),
        F.col("targetCount").cast("int").alias("target_count"),
    )
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def judge_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Baseline scores and variant scores of judge result lines."""
    r = spark.read.schema(JUDGE).json(path)
    base = r.filter(F.col("kind") == "baseline").select("model_id", "task_id", "parsed.scores")
    var = r.filter(F.col("kind") != "baseline").select("model_id", "task_id", "family", F.inline("parsed.variants"))
    return base, var


def verdicts(lines: DataFrame) -> DataFrame:
    """Last verdict of each execution; needs the line number of the append-only file."""
    rest = [c for c in lines.columns if c not in ("execution", "line_no")]
    return lines.groupBy("execution").agg(
        F.max_by(F.struct(*rest), "line_no").alias("_r")
    ).select("execution", "_r.*")


def variant_suites(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.schema(SUITE).json(path, multiLine=True)
    return s.select("task_id", "scenario_id", "status", F.inline("variants"))


def task_id_or_path(task_id: Column, scenario_id: Column, path: Column) -> Column:
    """Task id from the payload, from the scenario, or from the folder of the file."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.coalesce(
        task_id, F.concat(F.lit("ACB-"), scenario_id), F.when(folder != "", folder)
    )


def labelled_corpus(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Requests with a human score and a three-way label."""
    raw = spark.read.schema(
        "id string, text string, meta struct<`Normalized Score`:double,Binary:int>"
    ).json(path)
    return raw.select(
        F.lit(source).alias("source"),
        F.col("id").alias("source_id"),
        "text",
        F.col("meta.`Normalized Score`").alias("score"),
        F.col("meta.Binary").alias("label"),
    )


def numbered_lines(
    spark: SparkSession, path: str, skipped: str, of_file: Mapping[str, Column] | None = None
) -> DataFrame:
    """Lines of text files with their ``file`` and their zero-based ``row`` in it.

    Lines that match ``skipped`` have no number. Files are read in blocks, by many tasks where they
    are large, and a block's lines stand together in its task, so running ids number them without
    a shuffle; a block begins where the counts of those before it in the file end. Only these counts
    and first ids, one row a block, meet by file and are sent to all tasks. ``of_file`` names columns
    made from ``file``, once a block instead of once a line.
    """
    block = ["file", "_block"]
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.btrim("value").alias("line"),
        )
        .filter(~F.regexp_like("line", F.lit(skipped)))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = lines.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    more = of_file or {}
    made = [c.alias(name) for name, c in more.items()]
    begins = counts.select(*block, F.coalesce(before, F.lit(0)).alias("_begins"), "_first", *made)
    return lines.join(F.broadcast(begins), block).select(
        "file", (F.col("_begins") + F.col("_at") - F.col("_first")).alias("row"), "line", *more
    )


PARAMETERS = "array<struct<name string, value variant>>"


def tool_traces(spark: SparkSession, path: str, of_file: Mapping[str, Column] | None = None) -> DataFrame:
    """Calls of published traces with the place each came from.

    A file has one record a line, as JSON lines or as an array with its marks at the ends of lines;
    ``row`` counts records, also those that are no object or have no tool list, which give no call.
    ``domain`` is the folder of the file; ``tool_domain``, ``parent_tool`` and ``api`` are what the call
    itself names, NULL where it doesn't. ``args`` is canonical JSON, optional parameters before required
    ones of the same name; a response that is no text stays JSON. ``of_file`` names more columns, made
    from ``file``, which come first.
    """
    from agentrace.operators.library import canonical_map, flat_parameters

    get = lambda c, name, kind="string": F.try_variant_get(c, f"$['{name}']", kind)
    folder = F.regexp_extract("file", r"(?:^|/)(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    more = {**(of_file or {}), "domain": folder}
    records = numbered_lines(spark, path, r"^[\[\],]?$", more).select(
        "file", "row", *more, F.try_parse_json(F.regexp_replace("line", r"^\[|,$", "")).alias("_r")
    )
    tools = records.select(
        "file", "row", *more, F.posexplode(get(F.col("_r"), "tool list", "array<variant>")).alias("tool_index", "_t")
    )
    tool = F.col("_t")
    raw = lambda name: F.transform(
        F.coalesce(get(tool, name, PARAMETERS), F.array().cast(PARAMETERS)),
        lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.to_json(p["value"]), F.lit("null")).alias("value")),
    )
    named = lambda name: F.filter(raw(name), lambda p: p["name"].isNotNull())
    place = [*(of_file or ()), "file", "row", "tool_index", "domain"]
    # What is used twice below is a column of its own, or every use would take it from the call again.
    members = tools.select(
        *place,
        get(tool, "tool name").alias("tool_name"),
        get(tool, "domain name").alias("tool_domain"),
        get(tool, "parent tool name").alias("parent_tool"),
        get(tool, "API name").alias("api"),
        named("required parameters").alias("_needed"),
        named("optional parameters").alias("_given"),
        get(tool, "executed_output", "variant").alias("_output"),
        get(tool, "execution_status").alias("status"),
    )
    texts = members.select(
        *[c for c in members.columns if c not in ("_needed", "_given", "_output")],
        flat_parameters(F.col("_needed"), F.col("_given")).alias("_args"),
        F.to_json("_output").alias("_json"),
        F.try_variant_get("_output", "$", "string").alias("_text"),
        (F.schema_of_variant("_output") == "STRING").alias("_is_text"),
    )
    return texts.select(
        *place,
        "tool_name",
        "tool_domain",
        "parent_tool",
        "api",
        canonical_map(F.col("_args")).alias("args"),
        F.when(F.col("_is_text"), F.col("_text")).otherwise(F.nullif("_json", F.lit("null"))).alias("output"),
        "status",
    )
