"""Weisfeiler-Lehman subtree features and normalised similarity, over graph tables.

Relabelling hashes a node's label with the multiset of its neighbour strings. The multiset is
hashed as a sum of per-neighbour hashes: equal multisets give equal sums, partial sums combine
before the shuffle, and a hub node with any number of edges needs constant memory. Features are
only compared inside one task, so 64-bit labels are ample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.operators.graphs import PRECEDES, _lanes
from agentrace.operators.ordered import with_compact_key
from agentrace.session import materialize

REPEATS = 3


def repeat_column() -> Column:
    """The repeat of a run; a campaign with any other than the three is refused."""
    repeat = F.col("repeat")
    refused = F.raise_error(F.concat(F.lit("not a repeat of three: "), repeat.cast("string")))
    return F.when(repeat.between(0, REPEATS - 1), repeat).otherwise(refused)


PAIRS_WITHIN = tuple((i, j) for i in range(REPEATS) for j in range(i + 1, REPEATS))
PAIRS_ACROSS = tuple((i, j) for i in range(REPEATS) for j in range(REPEATS))


def _half_edges(edges: DataFrame, graph: Sequence[str]) -> DataFrame:
    """Both directions of every edge: ``_node`` gets a message of ``_nbr``; ``views`` stay if there are any."""
    end = lambda c: F.xxhash64(c)
    one = lambda node, nbr, tag: F.struct(
        end(node).alias("_node"), end(nbr).alias("_nbr"), F.xxhash64(F.lit(tag), "relation").alias("tag")
    )
    kept = [c for c in (*graph, "views") if c in edges.columns]
    return edges.select(*kept, F.inline(F.array(one("src", "dst", "OUT"), one("dst", "src", "IN"))))


def _in_view(masks: Column, view: int) -> Column:
    return masks.bitwiseAND(F.lit(1 << view)) != 0


def _label(view: int, i: int) -> str:
    """All views of a graph begin with the same label."""
    return f"l{i}_{view}" if i and view else f"l{i}"


def _relabelled(
    nodes: DataFrame, half: DataFrame, graph: Sequence[str], keep: Sequence[str], h: int, views: int = 1
) -> DataFrame:
    """Labels ``l0 … lh`` of ``nodes``, which have the columns of ``graph``, ``keep``, ``_node`` and ``l0``.

    Only longs travel along edges; the labels of a round come out dealt by (graph, node), which is
    how the next round needs them on both sides. With several views, nodes and half-edges tell by
    the bits of ``views`` which of them they belong to; a message then carries the labels of all
    views, so that a round costs one exchange of the edges whatever the number of views.
    """
    graph, labels = list(graph), nodes
    masks = ["views"] if views > 1 else []
    for i in range(1, h + 1):
        prev = list(dict.fromkeys(_label(v, i - 1) for v in range(views)))
        sent = labels.select(*graph, F.col("_node").alias("_nbr"), *prev, *[F.col(m).alias("_of") for m in masks])
        sums = []
        for v in range(views):
            along = _in_view(F.col("views").bitwiseAND(F.col("_of")), v) if masks else F.lit(True)
            message = F.xxhash64("tag", _label(v, i - 1))
            sums += [
                F.sum(F.when(along, F.shiftrightunsigned(message, 32))).alias(f"hi{v}"),
                F.sum(F.when(along, message.bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"lo{v}"),
                F.count_if(along).alias(f"deg{v}"),
            ]
        received = half.join(sent, [*graph, "_nbr"]).groupBy(*graph, "_node").agg(*sums)
        new = [
            F.xxhash64(_label(v, i - 1), *[F.coalesce(c, F.lit(0)) for c in (f"hi{v}", f"lo{v}", f"deg{v}")]).alias(_label(v, i))
            for v in range(views)
        ]
        known = dict.fromkeys(_label(v, j) for j in range(i) for v in range(views))
        labels = labels.join(received, [*graph, "_node"], "left").select(*keep, *graph, *masks, "_node", *known, *new)
    return labels


def wl_labels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], h: int = 2) -> DataFrame:
    """Node labels ``l0 … lh`` of every graph.

    Graphs and nodes are addressed by hashes while messages travel along edges, so the big
    shuffles carry four longs per half-edge; the key columns stay with the node rows.
    """
    graph = ["_k1", "_k2"]
    half = _half_edges(with_compact_key(edges, keys).drop("views"), graph)
    first = with_compact_key(nodes, keys).select(
        *keys, *graph, F.xxhash64("node_id").alias("_node"), F.xxhash64("label").alias("l0")
    )
    return _relabelled(first, half, graph, keys, h)


def _listed(labels: DataFrame, keys: Sequence[str], h: int) -> DataFrame:
    listed = F.array(*[F.col(f"l{i}") for i in range(h + 1)])
    return labels.select(*keys, F.posexplode(listed).alias("iteration", "feature"))


def wl_features(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    h: int = 2,
    include_order: bool = True,
) -> DataFrame:
    """One row per node and iteration: ``iteration``, ``feature``."""
    if not include_order:
        edges = edges.filter(F.col("relation") != PRECEDES)
    return _listed(wl_labels(nodes, edges, keys, h), keys, h)


def distinct_graphs(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], also: Sequence[str] = ()
) -> DataFrame:
    """One row per graph: its key, its content ``g1, g2``, ``n_nodes``, and whether it ``stands`` for that content.

    The content is 128 bits of sums of hashes of all nodes and edges, so it needs no order and its
    parts are combined before the shuffle. Of graphs with equal content, one stands for all.
    ``also`` names columns that nodes and edges have and that count as content.
    """
    part = lambda *c: [f for seed in (1, 2) for f in _lanes(F.lit(seed), *c)]
    lanes = [f"_s{i}" for i in range(4)]
    named = lambda hashes: [x.alias(n) for x, n in zip(hashes, lanes)]
    name = F.struct(*keys)
    of_nodes = with_compact_key(nodes, keys).select(
        "_k1", "_k2", name.alias("_key"), F.lit(1).alias("_n"), *named(part(F.lit("n"), "node_id", "label", *also))
    )
    of_edges = with_compact_key(edges, keys).select(
        "_k1", "_k2", name.alias("_key"), F.lit(0).alias("_n"), *named(part(F.lit("e"), "src", "dst", "relation", *also))
    )
    summed = (
        of_nodes.unionByName(of_edges)
        .groupBy("_k1", "_k2")
        .agg(F.first("_key").alias("_key"), F.sum("_n").alias("_n"), F.count("*").alias("_all"), *[F.sum(c).alias(c) for c in lanes])
    )
    content = [F.xxhash64(F.lit(seed), *lanes, "_n", "_all").alias(f"g{seed}") for seed in (1, 2)]
    graphs = materialize(summed.select("_key.*", "_k1", "_k2", *content, F.col("_n").alias("n_nodes")), "graphs")
    standing = graphs.groupBy("g1", "g2").agg(F.min(F.struct("_k1", "_k2")).alias("_first"))
    is_first = (F.col("_first._k1") == F.col("_k1")) & (F.col("_first._k2") == F.col("_k2"))
    return graphs.join(standing, ["g1", "g2"]).select(*keys, "_k1", "_k2", "g1", "g2", "n_nodes", is_first.alias("stands"))


def shared_features(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], h: int = 2) -> tuple[DataFrame, DataFrame]:
    """The content ``g1, g2`` of every graph, and ``iteration, feature, n`` of every content.

    Graphs of equal content share their features, which are computed for one of them.
    """
    nodes = materialize(nodes, "nodes")
    graphs = materialize(distinct_graphs(nodes, edges, keys), "graphs")
    first = graphs.where("stands").select("_k1", "_k2", "g1", "g2")
    content, own = ["g1", "g2"], ["_k1", "_k2"]
    stands = lambda df: with_compact_key(df, keys).join(first, own)
    labels = stands(nodes).select(*content, F.xxhash64("node_id").alias("_node"), F.xxhash64("label").alias("l0"))
    labels = _relabelled(labels, _half_edges(stands(edges).drop("views"), content), content, [], h)
    features = _listed(labels, content, h).groupBy(*content, "iteration", "feature").agg(F.count("*").alias("n"))
    return graphs, materialize(features, "features")


def view_features(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], views: Sequence[str], name: str = "view", h: int = 2
) -> tuple[DataFrame, DataFrame]:
    """The content of every graph, and ``iteration, feature, n`` of every content and view.

    A view is a part of a graph: bit i of the integer ``views`` of a node or edge tells whether it
    belongs to ``views[i]``, whose name is in column ``name`` of the features. All views of a graph
    are labelled by one run of the kernel, each with the labels that it would have alone: a
    message counts for a view if the edge and the node it comes from belong to it.
    """
    content = ["g1", "g2"]
    graphs, labels = _view_labels(nodes, edges, keys, views, h)
    listed = [
        F.when(
            _in_view(F.col("views"), v),
            F.struct(F.lit(view).alias(name), F.lit(i).alias("iteration"), F.col(_label(v, i)).alias("feature")),
        )
        for v, view in enumerate(views)
        for i in range(h + 1)
    ]
    rows = labels.select(*content, F.inline(F.array_compact(F.array(*listed))))
    features = rows.groupBy(*content, name, "iteration", "feature").agg(F.count("*").alias("n"))
    return graphs, materialize(features, "features")


def _view_labels(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], views: Sequence[str], h: int
) -> tuple[DataFrame, DataFrame]:
    """The content of every graph, and the labels of the nodes of every content."""
    masked = lambda df: df.withColumn("views", F.col("views").cast("int"))
    nodes, edges = materialize(masked(nodes), "nodes"), masked(edges)
    graphs = materialize(distinct_graphs(nodes, edges, keys, ["views"]), "graphs")
    first = graphs.where("stands").select("_k1", "_k2", "g1", "g2", "n_nodes")
    content = ["g1", "g2"]
    stands = lambda df: with_compact_key(df, keys).join(first, ["_k1", "_k2"])
    labels = stands(nodes).select(
        *content, "n_nodes", "views", F.xxhash64("node_id").alias("_node"), F.xxhash64("label").alias("l0")
    )
    return graphs, _relabelled(labels, _half_edges(stands(edges), content), content, ["n_nodes"], h, len(views))


#: Nodes of a graph for one list of its features, and nodes of a task for one part of its work, about.
LIST_NODES, PART_NODES = 1 << 9, 1 << 16


def _parts(n: Column, each: int) -> Column:
    """A power of two, so that features fall into parts by their low bits."""
    return F.pow(F.lit(2), F.greatest(F.ceil(F.log2(n / each)), F.lit(0))).cast("long")


def packed_features(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], views: Sequence[str], h: int = 2
) -> tuple[DataFrame, DataFrame]:
    """The features of ``view_features`` as lists ``codes, features, counts`` of a content.

    A code is view * (h + 1) + iteration. Features of a large graph fall into ``lots`` lists by their low
    bits, ``lot``, so no row grows with its graph.
    """
    content = ["g1", "g2"]
    graphs, labels = _view_labels(nodes, edges, keys, views, h)
    listed = [
        F.when(
            _in_view(F.col("views"), v),
            F.struct(F.lit(v * (h + 1) + i).cast("byte").alias("code"), F.col(_label(v, i)).alias("feature")),
        )
        for v in range(len(views))
        for i in range(h + 1)
    ]
    lots = _parts(F.col("n_nodes"), LIST_NODES).alias("lots")
    rows = labels.select(*content, lots, F.inline(F.array_compact(F.array(*listed))))
    counted = rows.groupBy(*content, "lots", "code", "feature").agg(F.count("*").alias("n"))
    counted = materialize(counted, "features")
    part = lambda c: F.transform("_list", lambda x: x[c])
    packs = (
        counted.withColumn("lot", F.col("feature").bitwiseAND(F.col("lots") - 1))
        .repartition(*content, "lot")
        .groupBy(*content, "lots", "lot")
        .agg(F.collect_list(F.struct("code", "feature", "n")).alias("_list"))
        .select(*content, "lots", "lot", part("code").alias("codes"), part("feature").alias("features"), part("n").alias("counts"))
    )
    return graphs, packs


def form_vectors(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feature counts of the (at most three) repeats of a form, side by side in one row.

    ``keys`` are the form keys, without the repeat. The table is written once: norms, internal
    pairs and both sides of the source-variant join all read it.
    """
    return _vectors(_form_ids(features, keys).withColumn("n", F.lit(1)))


def shared_vectors(graphs: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from the tables of ``shared_features``, or of ``view_features`` with the view as a key."""
    content = ["g1", "g2"]
    if set(keys) <= set(graphs.columns):
        # A graph is one row here and many in the join, so its form is hashed before it.
        forms = _form_ids(graphs, keys).select("_k1", "_k2", "_t1", "_t2", "family", "repeat", *content)
        return _vectors(forms.join(features, content))
    forms = graphs.select(*[k for k in keys if k in graphs.columns], "repeat", *content)
    return _vectors(_form_ids(forms.join(features, content), keys))


def _form_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes of a form (``_k1, _k2``) and of its task (``_t1, _t2``)."""
    task = [k for k in keys if k not in ("family", "form")]
    tasks = with_compact_key(df, task).withColumnsRenamed({"_k1": "_t1", "_k2": "_t2"})
    return with_compact_key(tasks, keys)


def _vectors(rows: DataFrame) -> DataFrame:
    ids = rows.withColumn("_source", F.col("family") == "source")
    counted = ids.groupBy("_k1", "_k2", "_t1", "_t2", "_source", "iteration", "feature").agg(
        *[F.sum(F.when(repeat_column() == r, F.col("n")).otherwise(0)).cast("double").alias(f"c{r}") for r in range(REPEATS)]
    )
    return materialize(counted, "vectors")


def _dots(left: str, right: str, pairs) -> list[Column]:
    return [
        F.sum(F.col(f"{left}{i}") * F.col(f"{right}{j}")).alias(f"d{i}{j}") for i, j in pairs
    ]


def _cosine(dot: Column, a: Column, b: Column) -> Column:
    """Two empty graphs are identical; an empty and a non-empty graph share nothing."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return (
        F.when((a == 0) & (b == 0), 1.0)
        .when((a == 0) | (b == 0), 0.0)
        .otherwise(F.coalesce(dot, F.lit(0.0)) / F.sqrt(a * b))
    )


def _pair_rows(
    pairs, left: str, right: str, left_has: str, right_has: str, dot: str = "d", views: Mapping[str, str] | None = None
) -> Column:
    """Pair structs of one form; pairs with a missing run are NULL and dropped later.

    ``views`` names the similarities and gives the suffix of the columns that each is made of.
    """
    return F.array(
        *[
            F.when(
                F.col(f"{left_has}{i}") & F.col(f"{right_has}{j}"),
                F.struct(
                    F.lit(i).alias("left_repeat"),
                    F.lit(j).alias("right_repeat"),
                    *[
                        _cosine(
                            F.col(f"{dot}{i}{j}{of}"), F.col(f"{left}{i}{of}"), F.col(f"{right}{j}{of}")
                        ).alias(name)
                        for name, of in (views or {"similarity": ""}).items()
                    ],
                ),
            )
            for i, j in pairs
        ]
    )


def run_presence(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which of the three runs of a form exist."""
    return runs.groupBy(*keys).agg(
        *[F.bool_or(repeat_column() == r).alias(f"h{r}") for r in range(REPEATS)]
    )


def pair_scores(
    vectors: DataFrame, runs: DataFrame, task_keys: Sequence[str]
) -> DataFrame:
    """Similarity of every run pair: source-internal, source-variant, variant-internal.

    ``task_keys`` identify a task (plus any extra dimension); runs also carry ``family`` and
    ``form``, vectors the hashes of both. The three repeats of a form sit in columns, so the nine dot
    products of a source-variant comparison come out of one join on (task, feature) and one
    aggregation; the work is linear in the number of features.
    """
    form_keys = [*task_keys, "family", "form"]
    form, task = ["_k1", "_k2"], ["_t1", "_t2"]
    present = _form_ids(run_presence(runs, form_keys), form_keys)
    inner = vectors.groupBy(*form).agg(
        *[F.sum(F.col(f"c{r}") * F.col(f"c{r}")).alias(f"n{r}") for r in range(REPEATS)],
        *_dots("c", "c", PAIRS_WITHIN),
    )
    forms = materialize(present.join(inner, form, "left"), "forms")

    within = forms.select(
        *form_keys,
        F.when(F.col("family") == "source", "source_internal")
        .otherwise("variant_internal")
        .alias("comparison"),
        F.explode(_pair_rows(PAIRS_WITHIN, "n", "n", "h", "h")).alias("p"),
    )

    source_vectors = vectors.filter("_source").select(
        *task, "iteration", "feature", *[F.col(f"c{r}").alias(f"s{r}") for r in range(REPEATS)]
    )
    across = (
        vectors.filter("NOT _source")
        .join(source_vectors, [*task, "iteration", "feature"])
        .groupBy(*form)
        .agg(*_dots("s", "c", PAIRS_ACROSS))
    )
    source = forms.filter(F.col("family") == "source").select(
        *task,
        *[F.col(f"n{r}").alias(f"sn{r}") for r in range(REPEATS)],
        *[F.col(f"h{r}").alias(f"sh{r}") for r in range(REPEATS)],
    )
    variant = (
        forms.filter(F.col("family") != "source")
        .drop(*[f"d{i}{j}" for i, j in PAIRS_WITHIN])
        .join(source, task)
        .join(across, form, "left")
        .select(
            *form_keys,
            F.lit("source_variant").alias("comparison"),
            F.explode(_pair_rows(PAIRS_ACROSS, "sn", "n", "sh", "h")).alias("p"),
        )
    )
    return (
        within.unionByName(variant)
        .filter(F.col("p").isNotNull())
        .select(*form_keys, "comparison", "p.left_repeat", "p.right_repeat", "p.similarity")
    )


def packed_pair_scores(
    graphs: DataFrame, packs: DataFrame, runs: DataFrame, task_keys: Sequence[str], names: Sequence[str], h: int = 2
) -> DataFrame:
    """Similarities of every run pair as in ``pair_scores``, a column of ``names`` for each view.

    Lists of features travel once, to their task, whose forms are counted and multiplied there; the
    task of many nodes is done in parts by the low bits of features. ``runs`` have no view.
    """
    form_keys = [*task_keys, "family", "form"]
    form, task, content = ["_k1", "_k2"], ["_t1", "_t2"], ["g1", "g2"]
    ids = _form_ids(graphs, form_keys).select(
        *form, *task, (F.col("family") == "source").alias("_source"), repeat_column().alias("repeat"), *content, "n_nodes"
    )
    parts = ids.groupBy(*task).agg(_parts(F.sum("n_nodes"), PART_NODES).alias("parts"))
    # A list is of one part where there are as many lists, and is divided otherwise.
    mask, within = F.col("parts") - 1, F.col("parts") <= F.col("lots")
    one = F.col("lot").bitwiseAND(mask)
    falls = lambda x: x.bitwiseAND(mask) == F.col("part")
    some = lambda c: F.when(within, F.col(c)).otherwise(
        F.filter(c, lambda _, i: falls(F.get("features", i)))
    )
    dealt = (
        ids.drop("n_nodes").join(parts, task).join(packs, content)
        .withColumn("part", F.explode(F.sequence(F.when(within, one).otherwise(F.col("lot")), F.when(within, one).otherwise(mask), F.col("lots"))))
        .select(*form, *task, "part", "_source", "repeat", *[some(c).alias(c) for c in ("codes", "features", "counts")])
        .repartition(*task, "part")
    )
    place = [*task, "part", "code", "feature"]
    counted = (
        dealt.select(*form, *task, "part", "_source", "repeat", "codes", "counts", F.posexplode("features").alias("_i", "feature"))
        .withColumns({"code": F.get("codes", F.col("_i")), "n": F.get("counts", F.col("_i"))})
        .groupBy(*form, *place, "_source")
        .agg(*[F.sum(F.when(F.col("repeat") == r, F.col("n")).otherwise(0)).cast("double").alias(f"c{r}") for r in range(REPEATS)])
    )
    beside = Window.partitionBy(*place)
    both = counted.withColumns(
        {f"s{r}": F.coalesce(F.sum(F.when(F.col("_source"), F.col(f"c{r}"))).over(beside), F.lit(0.0)) for r in range(REPEATS)}
    )
    sums, views = [], {name: f"_{v}" for v, name in enumerate(names)}
    for v, of in enumerate(views.values()):
        product = lambda a, b: F.sum(F.when(F.floor(F.col("code") / (h + 1)) == v, F.col(a) * F.col(b)))  # noqa: B023, E731
        sums += [product(f"c{r}", f"c{r}").alias(f"n{r}{of}") for r in range(REPEATS)]
        sums += [product(f"c{i}", f"c{j}").alias(f"d{i}{j}{of}") for i, j in PAIRS_WITHIN]
        sums += [product(f"s{i}", f"c{j}").alias(f"x{i}{j}{of}") for i, j in PAIRS_ACROSS]
    present = _form_ids(run_presence(runs, form_keys), form_keys)
    forms = materialize(present.join(both.groupBy(*form).agg(*sums), form, "left"), "forms")

    is_source = F.col("family") == "source"
    comparison = F.when(is_source, "source_internal").otherwise("variant_internal")
    internal = forms.select(
        *form_keys, comparison.alias("comparison"), F.explode(_pair_rows(PAIRS_WITHIN, "n", "n", "h", "h", views=views)).alias("p")
    )
    source = forms.filter(is_source).select(
        *task,
        *[F.col(f"n{r}{of}").alias(f"sn{r}{of}") for r in range(REPEATS) for of in views.values()],
        *[F.col(f"h{r}").alias(f"sh{r}") for r in range(REPEATS)],
    )
    variant = forms.filter(~is_source).join(source, task).select(
        *form_keys,
        F.lit("source_variant").alias("comparison"),
        F.explode(_pair_rows(PAIRS_ACROSS, "sn", "n", "sh", "h", "x", views)).alias("p"),
    )
    return internal.unionByName(variant).filter(F.col("p").isNotNull()).select(*form_keys, "comparison", "p.*")
