"""Operation graphs as two tables: labelled nodes and labelled directed edges.

``edges(keys…, src, dst, relation)`` keeps parallel edges as separate rows; ``nodes(keys…,
node_id, label)`` has one row per node. Entity nodes use their label as id; operation nodes are
``op:<ordinal>``.

Builders write the annotated log (and edges that are costly to derive) to the checkpoint folder
once, because nodes, edges and every kernel iteration read them again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.functions.rows import inline_once
from agentrace.functions.text import slug
from agentrace.operators.logs import (
    annotate_calls,
    grant_decisions,
    invocations,
    operations,
)
from agentrace.operators.ordered import running, with_compact_key
from agentrace.session import materialize

PRECEDES = "DIRECTLY_PRECEDES"
DIMENSIONS = ("permission", "information", "tool")
INFORMATION = ("ACCESSES", "READS", "DISCLOSES_TO", "HAS_OUTPUT")
TOOL = ("USES", "HAS_ARGUMENT", "CHANGES_STATE")


def op_id(ordinal: Column) -> Column:
    return F.concat(F.lit("op:"), ordinal.cast("string"))


def entity(kind: str, identity: Column) -> Column:
    return F.concat(F.lit(kind + ":"), slug(identity))


def _edge(dst: Column, relation: Column) -> Column:
    return F.struct(dst.alias("dst"), relation.alias("relation"))


def op_label(tool: Column, outcome: Column) -> Column:
    return F.concat(F.lit("op:"), slug(tool), F.lit("|outcome:"), outcome)


def operation_nodes(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ops.select(
        *keys,
        op_id(F.col("op_ord")).alias("node_id"),
        op_label(F.col("tool"), F.col("outcome")).alias("label"),
    )


def operation_edges(ops: DataFrame, keys: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Tool use, precedence and (optionally) argument edges, all row-local: operation ordinals
    are dense, so the predecessor of operation i is i - 1 and no lead or join is needed."""
    use = F.struct(
        op_id(F.col("op_ord")).alias("src"),
        entity("tool", F.col("tool")).alias("dst"),
        F.lit("USES").alias("relation"),
    )
    previous = F.struct(
        op_id(F.col("op_ord") - 1).alias("src"),
        op_id(F.col("op_ord")).alias("dst"),
        F.lit(PRECEDES).alias("relation"),
    )
    out = F.when(F.col("op_ord") > 0, F.array(use, previous)).otherwise(F.array(use))
    if extra is not None:
        out = F.concat(out, extra)
    return inline_once(ops, out, "src", *keys)


def entity_nodes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct non-operation endpoints, deduplicated map-side first."""
    return (
        edges.filter(~F.col("dst").startswith("op:"))
        .select(*keys, F.col("dst").alias("node_id"))
        .distinct()
        .withColumn("label", F.col("node_id"))
    )


def assemble(op_nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return op_nodes.unionByName(entity_nodes(edges, keys)), edges


def trajectory_graph(
    log: DataFrame, keys: Sequence[str], parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Graph of tool invocations; scalar arguments become argument nodes."""
    ops = materialize(invocations(log, keys, parts), "invocations").withColumn(
        "_args", F.expr("cast(try_parse_json(arguments) as map<string, variant>)")
    )
    scalar = F.filter(
        F.map_entries("_args"),
        lambda e: ~F.regexp_like(
            F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")), F.lit("^(OBJECT|ARRAY)")
        ),
    )
    argument = lambda e: F.struct(
        op_id(F.col("op_ord")).alias("src"),
        entity(
            "argument",
            F.concat(e["key"], F.lit("="), slug(F.coalesce(F.to_json(e["value"]), F.lit("null")))),
        ).alias("dst"),
        F.lit("HAS_ARGUMENT").alias("relation"),
    )
    empty = F.expr("cast(array() as array<struct<src: string, dst: string, relation: string>>)")
    extra = F.coalesce(F.transform(scalar, argument), empty)
    # Arguments are parsed once; nodes and every use of the edges read what is written.
    edges = materialize(operation_edges(ops, keys, extra), "edges")
    return assemble(operation_nodes(ops, keys), edges, keys)


def permission_graph(
    log: DataFrame, keys: Sequence[str], parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Graph of a permission plan: calls and the fields they request."""
    tagged = materialize(annotate_calls(log, keys, parts), "calls")
    ops = operations(tagged, keys)
    requests = tagged.filter(
        (F.col("type") == "permission_request") & F.col("active_op").isNotNull()
    ).select(
        *keys,
        op_id(F.col("active_op")).alias("src"),
        entity("field", F.coalesce("field", F.lit("unknown"))).alias("dst"),
        F.concat(
            F.lit("REQUESTS:read|scope="), slug(F.coalesce("scope", F.lit("unknown")))
        ).alias("relation"),
    )
    edges = operation_edges(ops, keys).unionByName(requests)
    return assemble(operation_nodes(ops, keys), edges, keys)


def sandbox_graph(
    log: DataFrame, keys: Sequence[str], parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Graph of an app-sandbox run: calls, permissions, reads, disclosures, state changes."""
    tagged = materialize(annotate_calls(log, keys, parts), "calls")
    ops = operations(tagged, keys)
    active = tagged.filter(F.col("active_op").isNotNull())
    src = op_id(F.col("active_op")).alias("src")

    requests = grant_decisions(tagged, keys, parts).filter(F.col("active_op").isNotNull()).select(
        *keys,
        src,
        entity("resource", F.coalesce("app", F.lit("unknown"))).alias("dst"),
        F.concat(
            F.lit("REQUESTS:"),
            slug(F.coalesce("operation", F.lit("access"))),
            F.lit("|scope="),
            slug(F.coalesce("scope", F.lit("unknown"))),
            F.lit("|decision="),
            F.col("decision"),
        ).alias("relation"),
    )
    app = F.coalesce("app", F.lit("unknown"))
    access = F.concat(
        F.array(_edge(entity("resource", app), F.lit("ACCESSES"))),
        F.transform(
            F.coalesce("fields", F.array().cast("array<string>")),
            lambda f: _edge(entity("field", F.concat(app, F.lit(":"), f)), F.lit("READS")),
        ),
    )
    disclosure = F.array(
        _edge(
            entity("recipient", F.coalesce("destination", "recipient", F.lit("unknown"))),
            F.lit("DISCLOSES_TO"),
        ),
        _edge(entity("output", F.coalesce("operation", F.lit("message"))), F.lit("HAS_OUTPUT")),
    )
    state = F.array(
        _edge(
            entity(
                "state",
                F.concat(
                    F.coalesce("app", F.lit("environment")),
                    F.lit(":"),
                    F.coalesce("destination", F.lit("state")),
                ),
            ),
            F.lit("CHANGES_STATE"),
        )
    )
    emitted = inline_once(
        active.filter(F.col("type").isin("access", "disclosure", "state_change")),
        F.when(F.col("type") == "access", access)
        .when(F.col("type") == "disclosure", disclosure)
        .otherwise(state),
        "dst",
        *keys,
        src,
    )
    edges = materialize(
        operation_edges(ops, keys).unionByName(requests).unionByName(emitted), "edges"
    )
    return assemble(operation_nodes(ops, keys), edges, keys)


def primary_relation(relation: Column, dimension: str) -> Column:
    if dimension == "permission":
        return relation.startswith("REQUESTS:")
    return relation.isin(*(INFORMATION if dimension == "information" else TOOL))


def project(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    dimensions: Sequence[str] = DIMENSIONS,
) -> tuple[DataFrame, DataFrame]:
    """Behavioural projections, one graph per dimension in the extra column ``dimension``.

    Selected operations are the operation endpoints of primary edges (all operations for the
    tool dimension); tool-use edges of selected operations and the order between two selected
    operations are kept besides the primary edges.
    """
    dims = F.array(*[F.lit(d) for d in dimensions])
    tagged = edges.withColumn("dimension", F.explode(dims))
    primary = F.lit(False)
    for dim in dimensions:
        primary = primary | (
            (F.col("dimension") == dim) & primary_relation(F.col("relation"), dim)
        )
    tagged = tagged.withColumn("primary", primary)
    key = [*keys, "dimension"]

    endpoints = (
        tagged.filter("primary")
        .select(*key, F.explode(F.array("src", "dst")).alias("op"))
        .filter(F.col("op").startswith("op:") & (F.col("dimension") != "tool"))
        .distinct()
    )
    every_op = nodes.filter(F.col("label").startswith("op:")).select(
        *keys, F.lit("tool").alias("dimension"), F.col("node_id").alias("op")
    )
    selected = endpoints.unionByName(every_op) if "tool" in dimensions else endpoints

    kept_primary = tagged.filter("primary").select(*key, "src", "dst", "relation")
    context = tagged.filter(~F.col("primary") & F.col("relation").isin("USES", PRECEDES))
    by_src = context.join(selected.withColumnRenamed("op", "src"), [*key, "src"], "left_semi")
    uses = by_src.filter(F.col("relation") == "USES").select(*key, "src", "dst", "relation")
    order = (
        by_src.filter(F.col("relation") == PRECEDES)
        .join(selected.withColumnRenamed("op", "dst"), [*key, "dst"], "left_semi")
        .select(*key, "src", "dst", "relation")
    )
    kept = materialize(kept_primary.unionByName(uses).unionByName(order), "projection")
    ends = kept.select(*key, F.explode(F.array("src", "dst")).alias("node_id"))
    if "tool" in dimensions:
        ends = ends.unionByName(every_op.withColumnRenamed("op", "node_id"))
    kept_nodes = ends.distinct().join(nodes, [*keys, "node_id"]).select(*key, "node_id", "label")
    return kept_nodes, kept


def project_views(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], dimensions: Sequence[str] = DIMENSIONS
) -> tuple[DataFrame, DataFrame]:
    """The projections of ``project`` as views of one graph: bit i of ``views`` is ``dimensions[i]``.

    Edges and nodes stay single rows. What an edge needs to know of its ends are the bits of the
    dimensions that select them, looked up once for either end.
    """
    own = ["_k1", "_k2"]
    bit = {dim: 1 << i for i, dim in enumerate(dimensions)}
    mask = lambda parts: reduce(Column.bitwiseOR, parts, F.lit(0))
    primary = mask(F.when(primary_relation(F.col("relation"), d), bit[d]).otherwise(0) for d in dimensions)
    tool = F.lit(bit.get("tool", 0))
    edges = with_compact_key(edges, keys).withColumn("_primary", primary)
    nodes = with_compact_key(nodes, keys)

    ends = F.explode(F.array("src", "dst"))
    endpoints = edges.select(*own, "_primary", ends.alias("_op")).filter(F.col("_op").startswith("op:"))
    every_op = nodes.filter(F.col("label").startswith("op:")).select(*own, tool.alias("_m"), F.col("node_id").alias("_op"))
    selected = (
        endpoints.select(*own, F.col("_primary").bitwiseAND(F.bitwise_not(tool)).alias("_m"), "_op")
        .filter("_m <> 0")
        .unionByName(every_op)
        .groupBy(*own, "_op")
        .agg(F.bit_or("_m").alias("_m"))
    )
    end = lambda c: selected.select(*own, F.col("_op").alias(c), F.col("_m").alias(f"_{c}"))
    bits = lambda c: F.coalesce(F.col(c), F.lit(0))
    context = F.when(F.col("relation") == "USES", bits("_src")).when(
        F.col("relation") == PRECEDES, bits("_src").bitwiseAND(bits("_dst"))
    )
    kept = (
        edges.join(end("src"), [*own, "src"], "left")
        .join(end("dst"), [*own, "dst"], "left")
        .withColumn("views", F.col("_primary").bitwiseOR(F.coalesce(context, F.lit(0))))
        .filter("views <> 0")
        .select(*keys, *own, "src", "dst", "relation", "views")
    )
    kept = materialize(kept, "projection")
    touched = kept.select(*own, "views", ends.alias("node_id"))
    ops = every_op.filter("_m <> 0").select(*own, F.col("_m").alias("views"), F.col("_op").alias("node_id"))
    of_nodes = touched.unionByName(ops).groupBy(*own, "node_id").agg(F.bit_or("views").alias("views"))
    kept_nodes = nodes.join(of_nodes, [*own, "node_id"]).select(*keys, "node_id", "label", "views")
    return kept_nodes, kept.drop(*own)


def validation_report(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Graphs that break the structural rules: a node with two labels, an edge without node."""
    conflicts = (
        nodes.groupBy(*keys, "node_id")
        .agg((F.min("label") != F.max("label")).alias("bad"))
        .filter("bad")
        .select(*keys, F.lit("conflicting_label").alias("problem"), "node_id")
    )
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    dangling = ends.join(nodes, [*keys, "node_id"], "left_anti").select(
        *keys, F.lit("dangling_endpoint").alias("problem"), "node_id"
    )
    return conflicts.unionByName(dangling)


def temporal_chain(log: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Edges between consecutive raw events of a log."""
    scanned = running(
        log.select(*keys, "type", "event_id"), keys, "event_id", before={"_prev": F.col("event_id")}, parts=parts
    )
    return scanned.filter(F.col("_prev").isNotNull()).select(
        *keys,
        F.concat(F.lit("event:"), F.col("_prev").cast("string")).alias("src"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("dst"),
        F.lit("NEXT_OBSERVED").alias("relation"),
        F.col("type").alias("dst_type"),
    )


def _lanes(*parts: Column) -> list[Column]:
    """Two 32-bit halves of a 64-bit hash; sums of halves are order-free and cannot overflow
    below two billion summands."""
    h = F.xxhash64(*parts)
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def signatures(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free 256-bit fingerprint of each graph (nodes, labels and edges as a multiset).

    Summed hashes combine map-side, so no graph is ever collected into one row.
    """
    parts = nodes.select(
        *keys, F.lit("n").alias("t"), F.col("node_id").alias("a"), F.col("label").alias("b"),
        F.lit("").alias("c"),
    ).unionByName(
        edges.select(*keys, F.lit("e").alias("t"), F.col("src").alias("a"),
                     F.col("dst").alias("b"), F.col("relation").alias("c"))
    )
    h1 = _lanes(F.lit(1), F.col("t"), F.col("a"), F.col("b"), F.col("c"))
    h2 = _lanes(F.lit(2), F.col("t"), F.col("c"), F.col("b"), F.col("a"))
    return (
        parts.groupBy(*keys)
        .agg(
            *[F.sum(c).alias(f"s{i}") for i, c in enumerate([*h1, *h2])],
            F.count_if(F.col("t") == "n").alias("n_nodes"),
            F.count_if(F.col("t") == "e").alias("n_edges"),
        )
        .select(
            *keys,
            "n_nodes",
            "n_edges",
            F.concat_ws("-", *[F.hex(F.col(f"s{i}")) for i in range(4)]).alias("signature"),
        )
    )


def serialize(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long JSON form for exchange: one record per node or edge, instead of one document per graph
    that would have to fit a single row. Readers sort the records of a graph if they need to."""
    n = nodes.select(
        *keys,
        F.lit("node").alias("part"),
        F.to_json(F.struct(F.col("node_id").alias("id"), F.col("label").alias("label"))).alias("record"),
    )
    e = edges.select(
        *keys,
        F.lit("edge").alias("part"),
        F.to_json(
            F.struct(
                F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label")
            )
        ).alias("record"),
    )
    return n.unionByName(e)
