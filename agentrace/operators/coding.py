"""Coding trajectories: shell commands to operations, graphs, final messages, trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.functions.text import slug
from agentrace.operators.graphs import PRECEDES, assemble, op_id
from agentrace.operators.ordered import running
from agentrace.session import materialize

# Program names per class of operation.
READ = (
    "cat", "head", "tail", "less", "more", "ls", "find", "grep", "rg", "wc", "file", "stat", "tree",
    "du", "od", "xxd", "hexdump", "strings", "readelf", "objdump", "nm", "diff", "cmp", "which",
    "whereis", "pwd", "echo", "printf", "env", "id", "whoami", "uname", "ps", "df", "awk", "sort",
    "uniq", "cut", "jq", "type",
)
WRITE = (
    "cp", "mv", "rm", "rmdir", "mkdir", "touch", "chmod", "chown", "tee", "ln", "tar", "unzip", "zip",
    "gzip", "gunzip", "patch", "truncate", "dd", "install",
)
INSTALL = (
    "pip", "pip3", "apt", "apt-get", "conda", "npm", "yarn", "pnpm", "cargo", "uv", "gem", "opam",
    "brew", "dpkg", "apk",
)
NETWORK = ("curl", "wget", "ssh", "scp", "nc", "telnet", "ping")
VCS = ("git",)
WRAPPERS = ("sudo", "env", "time", "timeout", "nohup")
NO_OPERATION = ("cd", "export", "source", ".")

# Tool names per family.
FILE_READ = ("read", "view", "notebookread", "read_file")
FILE_WRITE = ("write", "edit", "multiedit", "notebookedit", "apply_patch", "write_file", "str_replace_editor")
SEARCH = ("grep", "glob", "ls", "search", "list_dir")
WEB = ("webfetch", "websearch", "web_search", "fetch")
PLAN = ("todowrite", "update_plan", "task", "todoread", "exitplanmode")
SHELL = ("bash", "exec_command", "shell", "local_shell", "container.exec", "run_shell_command", "terminal")

# Paths and error texts.
PATH = (
    r"""(?U)(?:^|[\s'"=])((?:/|\./|\.\./)?[\w.\-]+(?:/[\w.\-]+)+|[\w\-]+\.[A-Za-z]{1,6})(?=$|[\s'";:,)])"""
)
ERROR = r"(Traceback|No such file|command not found|Permission denied|Error:|error:|FAILED|exit code [1-9])"

BALANCED = r"""^(?:[^"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')*$"""
TOKEN = r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+"""
PIECE = r"""(?:[^"'\\]+|\\.|"(?:[^"\\]|\\.)*"|'[^']*')"""


def unquoted(token: Column) -> Column:
    """What a shell makes of a token: between double quotes only quotes and backslashes are escaped."""

    def meant(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.char_length(piece) - 2)
        return (
            F.when(piece.startswith('"'), F.regexp_replace(inner, r"""\\(["\\])""", "$1"))
            .when(piece.startswith("'"), inner)
            .when(piece.startswith("\\"), F.substring(piece, 2, 1))
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(token, F.lit(PIECE), F.lit(0)), meant), "")


def shell_commands(command: Column) -> Column:
    """Simple commands of a shell line as token arrays, wrappers and assignments stripped."""
    parts = F.split(F.replace(command, F.lit("\n"), F.lit(" ; ")), r"\s*(?:&&|\|\||;|\|)\s*")

    def tokens(part: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0)), unquoted)
        plain = F.filter(F.split(part, r"\s+"), lambda t: t != "")
        return F.when(F.regexp_like(part, F.lit(BALANCED)), quoted).otherwise(plain)

    def strip(toks: Column) -> Column:
        skipped = F.transform(
            toks, lambda t: t.isin(*WRAPPERS) | F.regexp_like(t, F.lit(r"(?U)^\w+=\S*$"))
        )
        at = F.array_position(skipped, False).cast("int")
        rest = F.slice(toks, F.greatest(at, F.lit(1)), F.size(toks))
        gone = (at == 0) | F.coalesce(F.get(rest, F.lit(0)).isin(*NO_OPERATION), F.lit(False))
        return F.when(gone, F.array().cast("array<string>")).otherwise(rest)

    filled = F.filter(parts, lambda p: F.btrim(p) != "")
    return F.filter(F.transform(filled, lambda p: strip(tokens(p))), lambda c: F.size(c) > 0)


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def classify(toks: Column) -> Column:
    prog = basename(toks[0])
    pip = (
        prog.isin("python", "python3")
        & (F.size(toks) > 2)
        & (F.get(toks, F.lit(1)) == "-m")
        & (F.get(toks, F.lit(2)) == "pip")
    )
    return (
        F.when((prog == "sed") & F.exists(toks, lambda t: t.startswith("-i")), "write")
        .when(F.coalesce(pip, F.lit(False)), "install")
        .when(prog.isin(*READ, "sed"), "read")
        .when(prog.isin(*WRITE), "write")
        .when(prog.isin(*INSTALL), "install")
        .when(prog.isin(*NETWORK), "network")
        .when(prog.isin(*VCS), "vcs")
        .otherwise("build_run")
    )


def paths(text: Column) -> Column:
    """Distinct paths in a text, sorted; plain numbers are not paths."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    found = F.transform(
        F.regexp_extract_all(padded, F.lit(PATH), F.lit(1)), lambda p: F.rtrim(p, F.lit(".,:"))
    )
    kept = F.filter(found, lambda p: ~F.regexp_like(p, F.lit(r"^\d+(\.\d+)*$")))
    return F.array_sort(F.array_distinct(kept))


def step_calls(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tool calls of agent steps with the observation that carries the call's id."""
    result = F.filter(
        F.coalesce("observation.results", F.array().cast("array<struct<source_call_id:string,content:string>>")),
        lambda r: r["source_call_id"] == F.col("call.tool_call_id"),
    )
    return (
        steps.filter(F.col("source") == "agent")
        .select(*keys, "step", "observation", F.posexplode("tool_calls").alias("call_no", "call"))
        .select(
            *keys,
            (F.shiftleft(F.col("step").cast("long"), 32) + F.col("call_no")).alias("event_id"),
            F.lower("call.function_name").alias("function_name"),
            F.col("call.arguments").alias("arguments"),
            F.coalesce(F.try_element_at(result, F.lit(-1))["content"], F.lit("")).alias("observed"),
        )
    )


def _op(kind, family, outcome, program, found) -> Column:
    return F.struct(
        kind.alias("kind"),
        family.alias("tool"),
        outcome.alias("outcome"),
        program.alias("program"),
        found.alias("paths"),
    )


def command_text(name: str) -> Column:
    """A command argument as one line, NULL if empty; a list is joined, less its ``bash -lc``."""
    path = f"$.{name}"
    value = F.get_json_object("arguments", path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("arguments"), path, "variant"))
    words = F.from_json(value, "array<string>")
    wrapped = (F.get(words, F.lit(0)) == "bash") & F.get(words, F.lit(1)).isin("-lc", "-c")
    kept = F.when(F.coalesce(wrapped, F.lit(False)), F.slice(words, 3, F.size(words))).otherwise(words)
    listed = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    return F.nullif(F.when(listed, F.array_join(kept, " ")).otherwise(value), F.lit(""))


def call_operations(calls: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """One row per operation with its dense ordinal in the trajectory.

    A call yields an array of operations; a running sum of array sizes gives the ordinals.
    """
    name = F.col("function_name")
    parsed = F.coalesce(F.json_object_keys("arguments").isNotNull(), F.lit(False))
    arg = lambda k: F.get_json_object("arguments", f"$.{k}")
    raw = F.when(~parsed, F.col("arguments"))
    command = F.coalesce(command_text("command"), command_text("cmd"), raw, F.lit(""))
    has_command = F.coalesce(F.array_contains(F.json_object_keys("arguments"), "command"), ~parsed)
    outcome = F.when(F.regexp_like("observed", F.lit(ERROR)), "error").otherwise("ok")
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")

    commands = shell_commands(command)
    listed = F.when(F.size(commands) > 0, commands).otherwise(F.array(F.array(F.lit("<empty>"))))
    shell = F.transform(
        listed,
        lambda t: _op(
            classify(t), F.lit("shell"), F.col("_outcome"), basename(t[0]),
            paths(F.array_join(F.slice(t, 2, F.size(t)), " ")),
        ),
    )
    target = F.coalesce(arg("file_path"), arg("path"), F.lit(""))
    patched = F.array_sort(
        F.array_distinct(
            F.regexp_extract_all(
                F.coalesce(arg("input"), arg("patch"), F.lit("")),
                F.lit(r"\*\*\* (?:Add|Update|Delete) File: (\S+)"),
                F.lit(1),
            )
        )
    )
    written = F.when(F.size(paths(target)) > 0, paths(target)).otherwise(patched)
    url = F.coalesce(arg("url"), F.lit(""))
    host = F.when(url == "", "web_search").otherwise(F.regexp_replace(url, r"^https?://([^/]+).*", "$1"))
    cleaned = F.regexp_replace(name, r"(?U)\W+", "_")
    other = F.when(cleaned == "", "unknown").otherwise(cleaned)
    single = lambda *a: F.array(_op(*a))
    ops = (
        F.when(name.isin(*SHELL) | (has_command & ~name.isin(*FILE_WRITE)), shell)
        .when(name.isin(*FILE_READ), single(F.lit("read_file"), F.lit("file"), F.col("_outcome"), null, paths(target)))
        .when(name.isin(*FILE_WRITE), single(F.lit("write_file"), F.lit("file"), F.col("_outcome"), null, written))
        .when(name.isin(*SEARCH), single(F.lit("search"), F.lit("search"), F.col("_outcome"), null, paths(F.coalesce(arg("path"), F.lit("")))))
        .when(name.isin(*WEB), single(F.lit("network"), F.lit("web"), F.col("_outcome"), null, F.array(host)))
        .when(name.isin(*PLAN), single(F.lit("plan"), F.lit("plan"), F.lit("ok"), null, none))
        .otherwise(single(F.lit("other"), other, F.col("_outcome"), null, none))
    )
    listed_ops = materialize(
        calls.withColumn("_outcome", outcome).select(*keys, "event_id", ops.alias("ops")), "coding"
    )
    placed = running(listed_ops, keys, "event_id", sums={"_seen": F.size("ops")}, parts=parts)
    return placed.select(
        *keys, "event_id", (F.col("_seen") - F.size("ops")).alias("_first"), F.posexplode("ops").alias("_i", "op")
    ).select(*keys, (F.col("_first") + F.col("_i")).cast("long").alias("op_ord"), "op.*")


def coding_graph(ops: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of coding trajectories in the shared operation vocabulary."""
    src = op_id(F.col("op_ord"))
    label = F.concat(
        F.lit("op:"), F.col("kind"), F.lit("|tool:"), F.col("tool"), F.lit("|outcome:"), F.col("outcome")
    )
    nodes = ops.select(*keys, src.alias("node_id"), label.alias("label"))
    relation = (
        F.when(F.col("kind").isin("read", "read_file", "search"), "READS")
        .when(F.col("kind").isin("write", "write_file"), "CHANGES_STATE")
        .when(F.col("kind") == "network", "DISCLOSES_TO")
        .otherwise("ACCESSES")
    )
    target = F.when(F.col("kind") == "network", "recipient:").otherwise("resource:")
    edge = lambda s, d, r: F.struct(s.alias("src"), d.alias("dst"), r.alias("relation"))
    base = F.array_compact(
        F.array(
            edge(src, F.concat(F.lit("tool:"), slug(F.col("tool"))), F.lit("USES")),
            F.when(
                F.coalesce("program", F.lit("")) != "",
                edge(src, F.concat(F.lit("argument:"), slug(F.concat(F.lit("program="), F.col("program")))), F.lit("HAS_ARGUMENT")),
            ),
            F.when(F.col("op_ord") > 0, edge(op_id(F.col("op_ord") - 1), src, F.lit(PRECEDES))),
        )
    )
    touched = F.transform("paths", lambda p: edge(src, F.concat(target, slug(p)), relation))
    return assemble(nodes, ops.select(*keys, F.inline(F.concat(base, touched))), keys)


def final_messages(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Message of the last agent step that has text and calls no tool; empty without one."""
    silent = (
        (F.col("source") == "agent")
        & (F.coalesce("message", F.lit("")) != "")
        & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)
    )
    return steps.groupBy(*keys).agg(
        F.coalesce(
            F.max_by(F.when(silent, F.col("message")), F.when(silent, F.col("step"))), F.lit("")
        ).alias("final_message")
    )


# Exceptions that say nothing about the agent.
INFRA = ("AgentSetupTimeoutError", "NetworkConnectionError", "AgentAuthenticationError")


def trial_class() -> Column:
    """ok, infra, agent or running, from the recorded exception of a trial."""
    t, message = F.col("exception_type"), F.coalesce("exception_message", F.lit(""))
    return (
        F.when(~F.col("has_result"), "running")
        .when(F.coalesce(t, F.lit("")) == "", "ok")
        .when(t.isin(*INFRA), "infra")
        .when((t == "NonZeroAgentExitCodeError") & F.contains(message, F.lit("apt-get")), "infra")
        .otherwise("agent")
    )


def task_form(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def counted_trials(trials: DataFrame, limit: int = 3) -> DataFrame:
    """Valid trials of each (agent, task form): the first three in path order.

    Ranked in two rounds over hash slices, so one form with most trials stays parallel.
    """
    valid = (
        trials.withColumn("outcome", trial_class())
        .withColumn("task_form", task_form(F.col("path")))
        .filter(F.col("outcome").isin("ok", "agent") & ~F.contains("job", F.lit("smoke")))
    )
    part = F.pmod(F.xxhash64("trial"), F.lit(64))
    first = Window.partitionBy("agent", "task_form", part).orderBy("trial")
    second = Window.partitionBy("agent", "task_form").orderBy("trial")
    return (
        valid.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= limit)
        .withColumn("ordinal", F.row_number().over(second))
        .filter(F.col("ordinal") <= limit)
        .drop("_r")
    )


def attempts_needed(trials: DataFrame, forms: DataFrame, wanted: int = 3) -> DataFrame:
    """Trials still missing per form of the full form list."""
    valid = (
        trials.withColumn("outcome", trial_class())
        .withColumn("task_form", task_form(F.col("path")))
        .filter(F.col("outcome").isin("ok", "agent"))
        .groupBy("agent", "task_form")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    need = F.lit(wanted) - F.coalesce("n", F.lit(0))
    return (
        forms.join(valid, ["agent", "task_form"], "left")
        .withColumn("need", need)
        .filter(F.col("need") > 0)
        .select("agent", "task_form", "need")
    )


def pass_rates(trials: DataFrame) -> DataFrame:
    """Run → form → family in task → task means of the reward; a missing reward is a fail."""
    parts = F.split("task_form", "__")
    runs = trials.select(
        "agent",
        parts[0].alias("task"),
        parts[1].alias("family"),
        "task_form",
        F.coalesce("reward", F.lit(0.0)).alias("reward"),
    )
    per_form = runs.groupBy("agent", "task", "family", "task_form").agg(F.avg("reward").alias("r"))
    per_task = per_form.groupBy("agent", "task", "family").agg(F.avg("r").alias("r"))
    return per_task.groupBy("agent", "family").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg("r").alias("pass_rate")
    )
