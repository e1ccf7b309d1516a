"""Near duplicates by fast similarity sketches, bands and exact verification.

A sketch has a fixed number of bins. In each of the first rounds every shingle of a set is thrown
into one hashed bin, and only bins that no earlier round filled take it, at its smallest hash; the
last rounds, one for each bin, throw all shingles into that bin, so every bin is filled at last. Most
sets are done after a few rounds. Equal bins estimate the overlap with the concentration of sampling
without replacement, also for sets smaller than the sketch. Sets that agree in all bins of a band
meet in its bucket; there a pivot is verified against the others on the whole shingle sets, and
what that doesn't connect is verified in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import SLICE_BYTES, fields, map_slices
from agentrace.llm.components import components
from agentrace.llm.packing import ROW, packed_texts, row_keys, rows_of, unpacked
from agentrace.llm.registry import query, table
from agentrace.llm.similarity import digest, shingle_sets, to_verify, verified
from agentrace.llm.wordhash import U64, mixed
from agentrace.session import materialize

WIDTH, PERCENT = 5, 85
#: Two sets that overlap by 85 % agree in a band with 0.38, so 32 bands miss them with 3e-7.
BANDS, BAND = 32, 6
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], bins: int = BANDS * BAND) -> np.ndarray:
    """One row of ``bins`` hashes per set; bins of an empty set stay at the largest hash."""
    out = np.full((len(sets), bins), EMPTY, U64)
    flat = out.reshape(-1)
    size = np.array(list(map(len, sets)), np.int64)
    item = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    base = np.repeat(np.arange(len(sets)) * bins, size)
    for r in range(2 * bins):
        if not len(item):
            break
        h = mixed(item + U64((2 * r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        if r < bins:
            # The bin comes from the upper half, the value from another mix of the whole.
            cell = base + (((h >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
        else:
            cell = base + (r - bins)
        free = flat[cell] == EMPTY
        value = mixed(h[free]) >> U64(1)
        np.minimum.at(flat, cell[free], value)
        full = (out != EMPTY).all(axis=1)
        if full.any():
            kept = ~full[base // bins]
            item, base = item[kept], base[kept]
    return out


def bands(sketch: np.ndarray, per: int = BAND) -> np.ndarray:
    """One hash per band of every sketch; bands of different numbers never agree."""
    count = sketch.shape[1] // per
    out = np.tile(mixed(np.arange(1, count + 1, dtype=U64)), (len(sketch), 1))
    for i in range(per):
        out = mixed(out * U64(0x9FB21C651E98DF25) + sketch[:, i::per])
    return out.view(np.int64)


def sketched(source: DataFrame, width: int) -> DataFrame:
    """Per row the size and digest of its shingle set, and the hashes of its sketch's bands."""
    schema = fields(source, *ROW, "doc_id", n="bigint", set="binary", bands="array<bigint>")

    def describe(batch):
        sets = shingle_sets(batch.column("text"), width)[0]
        hashes = bands(sketches(sets))
        ends = pa.array(np.arange(0, hashes.size + 1, hashes.shape[1], dtype=np.int32))
        return {
            **{name: batch.column(name) for name in (*ROW, "doc_id")},
            "n": list(map(len, sets)),
            "set": list(map(digest, sets)),
            "bands": pa.ListArray.from_arrays(ends, pa.array(hashes.ravel())),
        }

    return map_slices(source, describe, schema, "text")


def shared_buckets(sets: DataFrame) -> DataFrame:
    """``band, set, label, weight`` of all buckets that hold several sets.

    A set's weight is the summed size of its buckets: the text that a group's others were made
    from agrees with more of them than they do with each other.
    """
    members = sets.select(F.explode("bands").alias("band"), "set")
    several = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(members.join(several, "band"), "sketch-shared")
    weights = shared.groupBy("set").agg(F.sum("n").alias("weight"))
    return shared.join(weights, "set").select("band", "set", F.col("set").alias("label"), "weight")


def unconnected(members: DataFrame) -> DataFrame:
    """Members of buckets whose sets aren't all connected yet, each with its bucket's pivot.

    The pivot is the set of most weight. What is known of a bucket is combined in each task, and a
    bucket with very many members is split where they come back.
    """
    buckets = members.groupBy("band").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.struct("weight", "set", "label")).alias("pivot"),
    )
    wanted = buckets.where("low != high").select(
        "band", F.col("pivot.set").alias("pivot"), F.col("pivot.label").alias("pivot_label")
    )
    return members.join(wanted, "band")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def sets_of(texts: list[bytes], width: int):
    """Shingle sets of texts, computed for about a megabyte of them at a time."""
    held, size = [], 0
    for text in [*texts, None]:
        if held and (text is None or size + len(text) > SLICE_BYTES):
            yield from shingle_sets(pa.array([t.decode() for t in held], pa.string()), width)[0]
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)


def linked_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose whole shingle sets overlap enough.

    Pairs come sorted by pivot, whose set is computed once in a row; a pivot with very many pairs is
    split by adaptive execution.
    """
    packed = lambda name: texts.select(F.col("set").alias(name), F.col("packed").alias(f"text_{name}"))
    meeting = pairs.join(packed("b").hint("merge"), "b").join(packed("a").hint("merge"), "a")
    schema = fields(meeting, *pairs.columns)
    columns = tuple(pairs.columns)

    def verify(batch):
        names = batch.column("a").to_pylist()
        begins = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
        pivots = sets_of(unpacked(batch.select(["text_a"]).take(begins).rename_columns(["packed"])), width)
        others = sets_of(unpacked(batch.select(["text_b"]).rename_columns(["packed"])), width)
        begins, kept, pivot = set(begins), [], None
        for i, other in enumerate(others):
            if i in begins:
                pivot = next(pivots)
            both = overlap(pivot, other)
            if 100 * both >= percent * (len(pivot) + len(other) - both):
                kept.append(i)
        found = batch.select(list(columns)).take(pa.array(kept, pa.int64()))
        return {name: found.column(name) for name in columns}

    return map_slices(meeting, verify, schema, "text_b")


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``row1, row2, doc_id, n_shingles, component_id, kept``.

    Documents link when their sets of ``width``-word shingles overlap by ``percent`` of their union;
    A-Z are lower-cased, words stand between ASCII white space, and fewer words than a shingle's
    are one shingle. ``component_id`` is the smallest id that links reach, the document's own
    included; a row is ``kept`` if that is its own. Null and empty texts have no shingles and are
    linked with nothing; a null id is the smallest of a component only if no other is there.
    Repeated rows get equal rows; an empty table gives none.

    Equal sets are one from the start. Sets meet if a band agrees (see BANDS for what is missed at
    the threshold). Every bucket's pivot is verified against its other members and leaves: one
    comparison a member, which connects a group of near copies. Buckets whose members then aren't
    one component are put together where they share a set, and all pairs of such a cluster are
    verified in blocks.
    """
    source = rows_of(docs, id_col, text_col)
    described = materialize(sketched(source, width), "sketch-rows")
    sets = described.where("n > 0").groupBy("set").agg(
        F.min(F.struct(*ROW)).alias("row"), F.first("bands").alias("bands")
    )
    members = materialize(shared_buckets(sets), "sketch-buckets")
    chosen = described.where("n > 0").groupBy("set").agg(F.min(F.struct(*ROW)).alias("row"), F.first("n").alias("n"))
    wanted = chosen.join(members.select("set").distinct(), "set", "left_semi").select("set", "n", "row.*")
    texts = packed_texts(source).dropDuplicates([*ROW]).join(wanted.hint("merge"), [*ROW])
    texts = materialize(texts.select("set", "n", "packed"), "sketch-texts")
    members = materialize(unconnected(members), "sketch-open")
    met = members.where("label != pivot_label")
    pairs = materialize(met.select(F.col("pivot").alias("a"), F.col("set").alias("b")).distinct(), "sketch-pairs")
    links = materialize(linked_pairs(pairs, texts, width, percent), "sketch-links")
    known = materialize(components(links), "sketch-labels").select(F.col("node").alias("set"), F.col("label").alias("to"))
    rest = (
        members.where("set != pivot")
        .join(known, "set", "left")
        .select("band", "set", F.coalesce("to", "label").alias("label"), "weight")
    )
    rest = materialize(unconnected(rest), "sketch-rest")
    clusters = materialize(components(rest, "pivot", "set"), "sketch-clusters")
    rows = clusters.select(F.col("node").alias("set"), "label").join(texts.hint("merge"), "set")
    rows = materialize(rows.select("label", "set", "n", "packed"), "sketch-clustered")
    every = links.union(verified(to_verify(rows, width, percent), percent))
    labels = materialize(components(every), "sketch-components")
    labels = labels.withColumnRenamed("node", "set")
    member = described.select(*ROW, "doc_id", "n", "set").join(labels, "set", "left")
    member = member.select(*ROW, "doc_id", "n", F.coalesce("label", "set").alias("label"))
    smallest = member.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    # One more key than the aggregate is dealt by, so that a component with very many rows can be split.
    salt = lambda df: df.withColumn("salt", F.xxhash64("label"))
    return (
        salt(member)
        .join(salt(smallest), ["label", "salt"], "left")
        .select(
            *ROW,
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns; rows that repeat id and text stay alike."""
    kept = near_duplicates(docs, **options).where("kept").select(*ROW)
    rows = docs.select(F.struct("*").alias("row"), *row_keys("doc_id", "text"))
    return rows.join(kept, [*ROW], "left_semi").select("row.*")


NEAR_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN sized p ON x = p.doc_id JOIN sized q ON y = q.doc_id
  WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
side AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM side UNION SELECT r.x, s.y FROM reach r JOIN side s ON r.y = s.x),
least_reached AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least_reached ON d.doc_id = x
"""


@query("op11_near_duplicates", NEAR_SQL)
def op11_near_duplicates(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
