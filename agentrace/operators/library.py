"""Library of recorded tool calls: schemas, responses, lookup, search, overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.operators.ordered import with_compact_key
from agentrace.session import materialize

SUCCESS = ("success", "successful", "ok")
FAILED = r"^(?:error:|error |failed:|execution failed)"
SEARCH_TOKEN = r"-?[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}]+"


def search_tokens(text: Column) -> Column:
    """Signed numbers and letter or digit runs, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(SEARCH_TOKEN), F.lit(0))


def usable_response(output: Column, status: Column) -> Column:
    """Recorded output that is present, successful and not an error in disguise.

    A text that is JSON counts by its ``error``/``errors`` members; any other text is usable. A
    member that is a text is an error unless it is empty, whatever it says.
    """

    def truthy(path: str) -> Column:
        value = F.coalesce(F.get_json_object(output, path), F.lit("null"))
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(output), path, "variant"))
        is_text = F.coalesce(kind == "STRING", F.lit(False))
        return F.when(is_text, value != "").otherwise(
            ~value.isin("null", "false", "0", "0.0", "", "[]", "{}")
        )

    bad_status = (F.coalesce(status, F.lit("")) != "") & ~F.lower(status).isin(*SUCCESS)
    blank = F.btrim(output) == ""
    failed = F.regexp_like(F.lower(F.ltrim(output)), F.lit(FAILED))
    # A text is parsed only if it can have such a member, whose name may be escaped.
    mentions = F.contains(output, F.lit("error")) | F.contains(output, F.lit("\\"))
    return F.coalesce(
        output.isNotNull() & ~bad_status & ~blank & ~failed & ~(mentions & (truthy("$.error") | truthy("$.errors"))),
        F.lit(False),
    )


def flat_parameters(required: Column, optional: Column) -> Column:
    """Parameter values by name; an optional parameter overrides a required one."""
    kept = F.filter(required, lambda r: ~F.exists(optional, lambda o: o["name"] == r["name"]))
    return F.map_from_entries(
        F.transform(F.concat(kept, optional), lambda p: F.struct(p["name"], p["value"]))
    )


def json_text(value: Column) -> Column:
    """A text as JSON writes it, quoted and escaped; null is the word null."""
    member = F.to_json(F.struct(value.alias("k")))
    written = F.substring(member, F.lit(6), F.char_length(member) - 6)
    # Most texts have nothing to escape and need no JSON writer.
    plain = F.regexp_like(value, F.lit(r"\A[A-Za-z0-9 _.,:;/-]*\z"))
    return F.when(value.isNull(), "null").when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(written)


def canonical_map(values: Column) -> Column:
    """JSON of a flat map of raw JSON scalars, keys sorted, with a space after each mark."""
    entries = F.transform(
        F.sort_array(F.map_entries(values)), lambda e: F.concat(json_text(e["key"]), F.lit(": "), e["value"])
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def call_key(tool_id: Column, canonical_arguments: Column) -> Column:
    """Digest of the canonical record of tool and arguments; a missing part is null there."""
    arguments = F.coalesce(canonical_arguments, F.lit("null"))
    record = F.concat(F.lit('{"arguments": '), arguments, F.lit(', "tool_id": '), json_text(tool_id), F.lit("}"))
    return F.sha2(record, 256)


def schema_routes(tools: DataFrame, route: Sequence[str]) -> DataFrame:
    """One schema per route: conflicting shapes make a route ambiguous, otherwise the smallest
    canonical record is kept; defaults that differ between records are dropped and noted."""
    return tools.groupBy(*route).agg(
        F.count(F.lit(1)).alias("n_records"),
        (F.min("shape") != F.max("shape")).alias("ambiguous"),
        F.min("record").alias("record"),
        (F.coalesce(F.min("default"), F.lit("")) != F.coalesce(F.max("default"), F.lit(""))).alias("default_dropped"),
        F.min("tool_name").alias("first_alias"),
    )


def resolve_schemas(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Schema of each call: same name, agreeing in every attribute that the call has, schemas of
    the call's own ``domain`` preferred, and only if exactly one remains.

    Attributes are ``parent_tool`` and, where calls have these columns, ``api`` and ``tool_domain``
    (the domain that the call itself names); null and empty ones are left open. Aliases are counted
    per name with each attribute either given or left open; a call then needs two key lookups, and no
    call is ever paired with all schemas of its name.
    """
    any_ = F.lit("*")
    given = lambda c: F.struct(F.lit(1).alias("is"), F.col(c).alias("v"))
    left_open = F.struct(F.lit(0).alias("is"), F.lit("").alias("v"))
    attributes = ["parent_tool"] + [c for c in ("api",) if c in calls.columns]
    options = aliases.select("tool_name", "tool_id", F.explode(F.array(F.col("domain"), any_)).alias("_domain"), *attributes)
    for c in attributes:
        options = options.withColumn(f"_{c}", F.explode(F.array(given(c), left_open)))
    asked = [f"_{c}" for c in attributes]
    options = options.groupBy("tool_name", "_domain", *asked).agg(
        F.count(F.lit(1)).alias("_n"), F.min("tool_id").alias("_tool")
    )
    named = F.nullif("tool_domain", F.lit("")) if "tool_domain" in calls.columns else F.lit(None).cast("string")
    rows = calls.withColumns(
        {f"_{c}": F.when(F.coalesce(F.col(c), F.lit("")) != "", given(c)).otherwise(left_open) for c in attributes}
    ).withColumns({"_named": F.coalesce(named, any_), "_clash": F.coalesce(named != F.col("domain"), F.lit(False))})
    own = options.withColumnsRenamed({"_domain": "domain", "_n": "_n_own", "_tool": "_tool_own"})
    found = rows.join(own, ["tool_name", "domain", *asked], "left").join(
        options.withColumnRenamed("_domain", "_named"), ["tool_name", "_named", *asked], "left"
    )
    in_own = F.when(~F.col("_clash"), F.col("_n_own"))
    chosen = F.when(in_own == 1, F.col("_tool_own")).when(in_own.isNull() & (F.col("_n") == 1), F.col("_tool"))
    return found.withColumn("tool_id", chosen).drop(*asked, "_named", "_clash", "_n_own", "_tool_own", "_n", "_tool")


def response_mode(calls: DataFrame) -> DataFrame:
    """Most frequent response per call key, ties by response hash, and the alternatives count.

    Responses are counted per (key, hash) first; the winner is a map-side combined maximum.
    """
    hashed = calls.withColumn("response_hash", F.sha2("response", 256))
    counted = hashed.groupBy("call_key", "response_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("response").alias("response")
    )
    order = F.struct((-F.col("n")).alias("a"), F.col("response_hash").alias("b"))
    return (
        counted.groupBy("call_key")
        .agg(
            F.min_by(F.struct("response", "response_hash", "n"), order).alias("_w"),
            F.count(F.lit(1)).alias("alternatives"),
            F.sum("n").alias("observations"),
        )
        .select(
            "call_key",
            F.col("_w.response").alias("response"),
            F.col("_w.response_hash").alias("response_hash"),
            F.col("_w.n").alias("n"),
            "alternatives",
            (F.col("alternatives") > 1).alias("conflicting"),
            "observations",
        )
    )


def lookup_calls(requests: DataFrame, library: DataFrame) -> DataFrame:
    """Recorded response of each request; no record is a coverage gap."""
    lib = library.select("call_key", "response", F.lit(True).alias("_hit"))
    return requests.join(lib, "call_key", "left").withColumn(
        "coverage_gap", F.col("_hit").isNull()
    ).drop("_hit")


#: As many values, about, stand in a list of `_listed` at most; so many of them `token_search` repeats at a time.
LOT, CYCLE = 4096, 256


def _lots(n: Column) -> Column:
    return F.ceil(n / LOT).cast("int")


def _listed(rows: DataFrame, own: list[str], name: str, unique: str, to: str) -> DataFrame:
    """Values of ``name``, NULL included, of the rows of equal ``own`` in lists of bounded size, one a ``_lot``."""
    n = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    lot = F.pmod(F.xxhash64(unique), _lots(F.col("_n"))).cast("int").alias("_lot")
    values = F.transform(F.collect_list(F.struct(name)), lambda x: x[name])
    return rows.select(*dict.fromkeys([*own, name, unique])).join(n, own).groupBy(*own, lot).agg(values.alias(to))


def token_search(records: DataFrame, queries: DataFrame, record_id: str, text: str) -> DataFrame:
    """Records that contain every token of a query, through an inverted index.

    Records of the same tokens are one text, and so are queries: one text is searched for another once.
    Only a query's rarest token is looked up; the texts found there, each with its own tokens, are
    checked for the others. A token that most texts have joins nothing unless a query has no other.
    A query without tokens matches every record, which the caller gets by reading the records.

    Results come in blocks, some queries beside one record after the other, not all queries of a text
    beside each record: columns of a file store the same few ids over and over in little space.
    """
    tokens = lambda c: F.array_sort(F.array_distinct(search_tokens(F.col(c))))
    words = with_compact_key(records.select(record_id, tokens(text).alias("_words")), ["_words"])
    words = words.filter(F.size("_words") > 0).withColumnsRenamed({"_k1": "_w1", "_k2": "_w2"})
    words = materialize(words.withColumn("_row", F.monotonically_increasing_id()), "words")
    wanted = queries.select("query_id", tokens("query").alias("_wanted")).filter(F.size("_wanted") > 0)
    wanted = wanted.groupBy("query_id").agg(F.first("_wanted").alias("_wanted"))
    wanted = materialize(with_compact_key(wanted, ["_wanted"]), "wanted")
    texts = words.groupBy("_w1", "_w2").agg(F.first("_words").alias("_words"))
    asked = wanted.groupBy("_k1", "_k2").agg(F.first("_wanted").alias("_wanted"), F.count(F.lit(1)).alias("_n"))
    index = texts.select("_w1", "_w2", "_words", F.explode("_words").alias("token"))
    counts = index.groupBy("token").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = (
        asked.select("_k1", "_k2", "_wanted", "_n", F.explode("_wanted").alias("token"))
        .join(counts, "token", "left")
        .groupBy("_k1", "_k2")
        .agg(
            F.min_by("token", F.struct(F.coalesce("_texts", F.lit(0)), "token")).alias("token"),
            F.first("_wanted").alias("_wanted"),
            F.first("_n").alias("_n"),
        )
    )
    found = (
        index.join(rarest, "token")
        .filter(F.size(F.array_except("_wanted", "_words")) == 0)
        .select("_k1", "_k2", "_w1", "_w2", F.explode(F.sequence(F.lit(0), _lots(F.col("_n")) - 1)).alias("_lot"))
    )
    # A row here stands for as many results as its two lists have pairs, so tasks aren't merged by bytes.
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(tasks, "_k1", "_k2", "_lot")
    of_text = _listed(words, ["_w1", "_w2"], record_id, "_row", "_records").drop("_lot")
    of_query = _listed(wanted, ["_k1", "_k2"], "query_id", "query_id", "_queries")
    hits = dealt(found.join(of_text, ["_w1", "_w2"]).drop("_w1", "_w2")).join(dealt(of_query), ["_k1", "_k2", "_lot"])
    some = F.transform(
        F.sequence(F.lit(1), F.size("_queries"), F.lit(CYCLE)), lambda i: F.slice("_queries", i, F.lit(CYCLE))
    )
    return (
        hits.select("_records", F.explode(some).alias("_queries"))
        .select("_queries", F.explode("_records").alias(record_id))
        .select(F.explode("_queries").alias("query_id"), record_id)
    )


#: Stands for "no arguments" in the postings of arguments; no search token is empty.
BARE = ""


def call_search(
    tools: DataFrame, calls: DataFrame, queries: DataFrame, call_id: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Recorded calls (query_id, call_id) whose tool and arguments hold all tokens of both fields.

    ``tools`` has tool_id and text, ``calls`` call_id, tool_id and arguments (JSON), ``queries`` query_id,
    query and argument_query; ids are unique. A call without arguments meets any argument query, an
    empty or NULL field asks for nothing; a query that asks for nothing at all matches every call, which
    the caller gets by reading them. An id that calls don't have but that follows from their columns is
    given as ``call_id``, never NULL, and made of what is found only; ``keep`` names columns of calls to add.

    The calls and their tokens are taken once and written. Tools are searched first, and a call is sent
    to its tool once, where it meets the tool's queries: 64 bits of tokens are compared before tokens are.
    A query that names no tool is looked up by its rarest token. The queries of a call stand together.
    """
    found_id = F.col("call_id") if call_id is None else call_id
    bits = lambda c: F.expr(f"aggregate({c}, 0L, (a, w) -> a | shiftleft(1L, cast(pmod(xxhash64(w), 64) AS int)))")
    asked_tokens = lambda c: F.array_distinct(search_tokens(F.coalesce(F.col(c), F.lit(""))))
    asked = queries.select(
        "query_id", "query", asked_tokens("query").alias("_named"), asked_tokens("argument_query").alias("_wanted")
    )
    asked = materialize(asked.withColumn("_wanted_bits", bits("_wanted")), "asked")
    names_tool, names_arguments = F.size("_named") > 0, F.size("_wanted") > 0
    bare = F.coalesce(F.btrim("arguments").isin("", "{}"), F.lit(True))
    none = F.array().cast("array<string>")
    words = F.when(bare, none).otherwise(F.array_distinct(search_tokens(F.col("arguments"))))
    stored = materialize(calls.select(*calls.columns, bare.alias("_bare"), words.alias("_words")), "calls")
    taken = stored.withColumn("_bits", bits("_words"))
    is_found = F.col("_bare") | (
        (F.col("_bits").bitwiseAND(F.col("_wanted_bits")) == F.col("_wanted_bits"))
        & (F.size(F.array_except("_wanted", search_tokens(F.col("arguments")))) == 0)
    )
    known = F.col("call_id").isNotNull() if call_id is None else F.lit(True)
    result = ["query_id", found_id.alias("call_id"), *keep]

    # A tool that comes twice is one tool to a query that names arguments, and two to one that doesn't.
    named = token_search(tools, asked.filter(names_tool), "tool_id", "text").groupBy("query_id", "tool_id")
    times = F.explode(F.array_repeat(F.lit(0), F.when(names_arguments, 1).otherwise(F.col("_times").cast("int")))).alias("_")
    tool_hits = (
        named.agg(F.count(F.lit(1)).alias("_times"))
        .join(asked.select("query_id", "_wanted", "_wanted_bits"), "query_id")
        .select("query_id", "tool_id", "_wanted", "_wanted_bits", times)
    )
    of_tools = taken.drop("_words").join(tool_hits, "tool_id").filter(~names_arguments | (known & is_found))

    free = asked.filter(~names_tool & names_arguments)
    tokens = free.select("query_id", F.explode("_wanted").alias("token"))
    postings = lambda df, kept: df.select(
        *kept, F.explode(F.when(F.col("_bare"), F.array(F.lit(BARE))).otherwise(F.col("_words"))).alias("token")
    )
    counts = postings(stored, []).join(tokens.select("token").distinct(), "token").groupBy("token")
    rarest = (
        tokens.join(counts.agg(F.count(F.lit(1)).alias("_calls")), "token", "left")
        .groupBy("query_id")
        .agg(F.min_by("token", F.struct(F.coalesce("_calls", F.lit(0)), "token")).alias("token"))
    )
    anchors = rarest.join(free.select("query_id", "_wanted", "_wanted_bits"), "query_id").select(
        "query_id", "_wanted", "_wanted_bits", F.explode(F.array("token", F.lit(BARE))).alias("token")
    )
    # Written, so that its size is known and few queries are sent to the calls, not the calls to them.
    anchors = materialize(anchors, "anchors")
    anywhere = postings(taken.filter(known), [*calls.columns, "_bare", "_bits"]).join(anchors, "token").filter(is_found)
    return of_tools.select(*result).unionAll(anywhere.select(*result))


def search_page(matches: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page of sorted matches of a single query, with the total number of matches.

    Every task keeps its first ``offset + limit`` rows only, so the matches are neither sorted nor stored
    as a whole. ``order`` must be total.
    """
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    first = matches.orderBy(*order).limit(offset + limit)
    ranked = first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    return ranked.filter(F.col("position") > offset).withColumn("total", total.scalar())


def manifest_counters(calls: DataFrame) -> DataFrame:
    ok = F.col("usable")
    return calls.agg(
        F.count(F.lit(1)).alias("observed_calls"),
        F.count_if(~ok).alias("excluded_missing_or_error_response"),
        F.count_if(ok & F.col("tool_id").isNull()).alias("unresolved_tool_schema"),
        F.count_if(ok & F.col("tool_id").isNotNull()).alias("accepted_observations"),
    )


def reference_overlap(expected: DataFrame, actual: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Multiset overlap of expected and actual calls: matched, extra and missing counts."""
    tagged = lambda df, e: df.select(*keys, item, F.lit(e).alias("_e"), F.lit(1 - e).alias("_a"))
    counted = (
        tagged(expected, 1)
        .unionByName(tagged(actual, 0))
        .groupBy(*keys, item)
        .agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    )
    # As in a join, an item or key that is NULL meets nothing.
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, item)])
    both = F.when(known, F.least("_e", "_a")).otherwise(F.lit(0))
    return counted.groupBy(*keys).agg(
        F.sum("_e").alias("expected"),
        F.sum(both).alias("matched"),
        F.sum(F.col("_a") - both).alias("extra"),
        F.sum(F.col("_e") - both).alias("missing"),
    )
