"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and a sample of unlabelled ones train linear classifiers in numpy. Their
risk is the prior-weighted loss of the positives plus an estimate of the negatives' loss: the loss
of the unlabelled as negatives, less the prior-weighted loss of the positives as negatives. Where a
step makes that estimate negative, which only overfitting can, the step goes back up instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, give_back, map_slices
from agentrace.llm.registry import query, table
from agentrace.llm.wordhash import U64, Words, mixed
from agentrace.session import materialize

#: Bounds of the samples that are learned from: labelled toxic, labelled clean (for calibration
#: only) and unlabelled documents. Each is drawn by a hash of the id over the whole table.
TOXIC, CLEAN, UNLABELLED = 4000, 4000, 12000
MEMBERS = 3
BITS = 18
PREFIXES = (None, 4, 5)
#: A feature counts if it is so many standard errors likelier in toxic texts, and occurs in at
#: least so many of them, by number and by share.
LEAST_Z, LEAST_COUNT, LEAST_SHARE = 4.0, 3, 0.005
EPOCHS, BATCH, RATE, DECAY = 25, 512, 0.05, 3e-4
THRESHOLD = 0.3


def between_words() -> np.ndarray:
    """Bytes of ASCII that are neither letters nor digits."""
    code = np.arange(256)
    return (code < 128) & ~np.array([chr(c).isalnum() for c in code])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word and of its first bytes; repeats are kept."""
    words = Words(texts, between_words())
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    kinds = [mixed(words.hashes(p) + U64(i)) >> U64(64 - BITS) for i, p in enumerate(PREFIXES)]
    return np.tile(text, len(kinds)), np.concatenate(kinds).astype(np.int32)


class Rows:
    """Sets of features of several texts: ``flat[start[i]:start[i + 1]]``."""

    def __init__(self, start: np.ndarray, flat: np.ndarray):
        self.start, self.flat = start, flat

    def __len__(self) -> int:
        return len(self.start) - 1

    def pick(self, at: np.ndarray) -> Rows:
        size = self.start[at + 1] - self.start[at]
        start = np.concatenate(([0], np.cumsum(size)))
        own = np.arange(start[-1]) - np.repeat(start[:-1], size)
        return Rows(start, self.flat[np.repeat(self.start[at], size) + own])

    def narrowed(self, place: np.ndarray) -> Rows:
        """Only features whose place isn't negative, renamed to it."""
        new = place[self.flat]
        kept = np.concatenate(([0], np.cumsum(new >= 0)))
        return Rows(kept[self.start], new[new >= 0])

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Summed weights over the root of their number, and the bias, which stands last."""
        total = np.bincount(self.text(), weights[self.flat], len(self))
        return total * self.scale() + weights[-1]

    def scale(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.diff(self.start), 1))

    def gradient(self, slope: np.ndarray, size: int) -> np.ndarray:
        """Of the weights, from the losses' slopes by logit."""
        out = np.bincount(self.flat, (slope * self.scale())[self.text()], size)
        out[-1] = slope.sum()
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def tallied(rows: DataFrame) -> DataFrame:
    """``name`` and, per part, how many toxic (``t0``, …) and unlabelled (``u0``, …) sets hold it."""
    names = [f"{kind}{part}" for kind in "tu" for part in range(MEMBERS)]

    def tally(batches):
        total = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in batches:
            lists = batch.column("found")
            kind = np.where(batch.column("toxic").to_numpy() == 1, 0, MEMBERS) + batch.column("part").to_numpy()
            row = np.repeat(kind, lists.value_lengths().to_numpy())
            flat = lists.flatten().to_numpy()
            for i in np.unique(kind):
                total[i] += np.bincount(flat[row == i], minlength=1 << BITS)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, total[:, seen])], ["name", *names])

    learned = rows.where("toxic != 0").select("toxic", "part", "found")
    counted = learned.mapInArrow(tally, "name long, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("name").agg(*[F.sum(n).alias(n) for n in names])


def telling(counts: DataFrame, sizes: dict[tuple[int, int], int]) -> list[np.ndarray]:
    """Per member, sorted, the features that are clearly likelier in the toxic texts it learns from.

    ``sizes`` are numbers of sets by (toxic, part); a member learns from all parts but its own.
    """
    flags = []
    for member in range(MEMBERS):
        parts = [p for p in range(MEMBERS) if p != member]
        n_toxic, n_other = (sum(sizes.get((kind, p), 0) for p in parts) for kind in (1, -1))
        seen = sum((F.col(f"t{p}") for p in parts), F.lit(0))
        base = (sum((F.col(f"u{p}") for p in parts), F.lit(0)) + 1) / F.lit(float(n_other + 2))
        error = F.sqrt(base * (1 - base) * (1 / max(n_toxic, 1) + 1 / max(n_other, 1)))
        least = max(LEAST_COUNT, LEAST_SHARE * n_toxic)
        flags.append((seen >= least) & (seen / F.lit(float(max(n_toxic, 1))) - base >= LEAST_Z * error))
    named = counts.select("name", F.array(*flags).alias("of")).where(F.exists("of", lambda x: x)).toArrow()
    names = named.column("name").to_numpy()
    of = np.array(named.column("of").to_pylist(), bool).reshape(-1, MEMBERS)
    return [np.sort(names[of[:, m]]) for m in range(MEMBERS)]


def nnpu(toxic: Rows, other: Rows, prior: float, size: int, seed: int) -> np.ndarray:
    """Weights of ``size`` features and a bias that minimise the non-negative risk (logistic loss)."""
    rng = np.random.default_rng(seed)
    weights, mean, square = (np.zeros(size + 1) for _ in range(3))
    batches = max(1, -(-len(other) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        parts = np.array_split(rng.permutation(len(other)), batches)
        order = rng.permutation(len(toxic))
        small = len(toxic) < 32 * batches
        for i, part in enumerate(parts):
            p = toxic.pick(order if small else order[i::batches])
            u = other.pick(part)
            zp, zu = p.logits(weights), u.logits(weights)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            up = -prior * sigmoid(zp) / len(p)
            uu = sigmoid(zu) / max(len(u), 1)
            if negative >= 0:
                up, uu = up - prior * sigmoid(-zp) / len(p), uu
            else:
                up, uu = -up, -uu
            slope = p.gradient(up, size + 1) + u.gradient(uu, size + 1)
            slope[:-1] += DECAY * weights[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope * slope
            pace = np.sqrt(square / (1 - 0.999**step)) + 1e-8
            weights = weights - RATE * mean / (1 - 0.9**step) / pace
    return weights


def calibration(z: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve through left-out logits, at the prior's class weights."""
    if not toxic.any() or toxic.all():
        return 1.0, 0.0
    share = np.where(toxic, prior / toxic.sum(), (1 - prior) / (~toxic).sum())
    x = np.column_stack((z, np.ones_like(z)))
    coef = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ coef)
        slope = x.T @ (share * (p - toxic)) + 1e-4 * (coef - [1.0, 0.0])
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        coef = coef - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return max(coef[0], 1e-3), coef[1]


@dataclass
class Model:
    """Classifiers by feature, with one calibration; without any, every score is the prior."""

    prior: float
    members: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def places(self) -> list[np.ndarray]:
        if "_places" not in self.__dict__:
            self._places = []
            for names, _ in self.members:
                place = np.full(1 << BITS, -1, np.int32)
                place[names] = np.arange(len(names))
                self._places.append(place)
        return self._places

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.members:
            return np.full(len(texts), self.prior)
        text, feature = features(texts)
        z = np.zeros(len(texts))
        for place, (names, weights) in zip(self.places(), self.members):
            new = place[feature]
            hit = np.unique(text[new >= 0] * np.int64(len(names)) + new[new >= 0])
            start = np.searchsorted(hit, np.arange(len(texts) + 1) * len(names))
            z += Rows(start, hit % max(len(names), 1)).logits(weights)
        return sigmoid(self.slope * z / len(self.members) + self.shift)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, held: int = 2) -> Model:
    """Learn from documents whose fold isn't ``held``; their labels are the only ones read.

    The prior is the share of toxic ones of all labelled documents there; an id labelled both ways
    is toxic. Three bounded samples of ids, smallest hashes first, are joined with the texts (one text
    of an id, the one of the smallest hash). Features are counted by label where the sets are, and
    only telling ones go on; each of the members trains in a task of its own, without a third of the
    rows, on whose labelled part the common calibration is then fitted. With no toxic document to learn from, the model scores
    every text with the prior (0 without labels).
    """
    fold = crc_fold(F.col("doc_id"))
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != held))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = (total.toxic or 0) / total.n if total.n else 0.0
    if not total.toxic:
        return Model(prior)
    pick = lambda df, n: df.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(n)
    open_ids = docs.where(F.col("doc_id").isNotNull() & (fold != held)).select("doc_id").distinct()
    sample = (
        pick(known.where("toxic = 1"), TOXIC)
        .unionByName(pick(known.where("toxic = 0"), CLEAN))
        .unionByName(pick(open_ids, UNLABELLED).withColumn("toxic", F.lit(-1)))
    )
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(one)
    schema = fields(chosen, "doc_id", "toxic", digest="bigint", found="array<int>")

    def sets(batch):
        text, feature = features(batch.column("text"))
        pairs = np.unique(text * np.int64(1 << BITS) + feature)
        start = np.searchsorted(pairs, np.arange(batch.num_rows + 1) << BITS)
        flat = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        return {
            "doc_id": batch.column("doc_id"),
            "toxic": batch.column("toxic"),
            "digest": checks(Rows(start, flat)).view(np.int64),
            "found": pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat)),
        }

    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(MEMBERS)).cast("int").alias("part")
    rows = map_slices(chosen, sets, schema, "text", give_back)
    rows = materialize(rows.select("toxic", "digest", "found", part), "toxicity-sets")
    sizes = {(r.toxic, r.part): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}
    chosen_names = telling(tallied(rows), sizes)
    every = np.unique(np.concatenate(chosen_names))
    schema = fields(rows, "toxic", "digest", "part", "found")

    def narrow(batch):
        lists = batch.column("found")
        start = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        flat = lists.flatten().to_numpy()
        kept = np.isin(flat, every)
        ends = np.concatenate(([0], np.cumsum(kept)))[start].astype(np.int32)
        columns = {name: batch.column(name) for name in ("toxic", "digest", "part")}
        return columns | {"found": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept]))}

    # Only telling features travel to the three tasks that learn.
    member_rows = map_slices(rows, narrow, schema).withColumn(
        "member", F.explode(F.array(*map(F.lit, range(MEMBERS))))
    )
    out = pa.schema([("member", pa.int32()), ("kind", pa.int32()), ("name", pa.int32()), ("value", pa.float64())])

    def learn(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        toxic, part, digest = (data.column(c).to_numpy() for c in ("toxic", "part", "digest"))
        member = data.column("member")[0].as_py()
        lists = data.column("found").combine_chunks()
        start = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        names = chosen_names[member]
        place = np.full(1 << BITS, -1, np.int32)
        place[names] = np.arange(len(names))
        sets = Rows(start, lists.flatten().to_numpy()).narrowed(place)
        # Rows come in any order: sorted by content, a member learns the same from equal data.
        order = np.lexsort((np.diff(start), digest, toxic))
        apart = order[(part[order] == member) & (toxic[order] >= 0)]
        mine = order[part[order] != member]
        positive, other = sets.pick(mine[toxic[mine] == 1]), sets.pick(mine[toxic[mine] == -1])
        if not len(positive):
            return out.empty_table()
        weights = nnpu(positive, other, prior, len(names), member)
        z = sets.pick(apart).logits(weights)
        kinds = [np.full(len(weights), 2), toxic[apart]]
        labels_of = [np.append(names, -1), np.zeros(len(apart))]
        kind, name, value = map(np.concatenate, (kinds, labels_of, [weights, z]))
        return pa.table(
            [np.full(len(kind), member, np.int32), kind.astype(np.int32), name.astype(np.int32), value],
            schema=out,
        )

    learned = member_rows.groupBy("member").applyInArrow(learn, "member int, kind int, name int, value double")
    got = learned.toArrow()
    member, kind, name, value = (got.column(c).to_numpy() for c in got.column_names)
    members = []
    for i in range(MEMBERS):
        mine = (member == i) & (kind == 2)
        if mine.any():
            order = np.argsort(name[mine])  # the bias has the name -1
            members.append((name[mine][order][1:], np.roll(value[mine][order], -1)))
    tested = kind != 2
    slope, shift = calibration(value[tested], kind[tested] == 1, prior)
    return Model(prior, members, float(slope), float(shift))


def checks(rows: Rows) -> np.ndarray:
    """A number per set of features."""
    total = np.concatenate(([0], np.cumsum(mixed(rows.flat.astype(U64) + U64(1)), dtype=U64)))
    return total[rows.start[1:]] - total[rows.start[:-1]]


def scored(
    docs: DataFrame,
    model: Model,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``. A null text counts as empty.

    Only the text is scored; empty texts get the score of a text without telling words. Repeated
    rows get equal scores; an empty table gives none. The model is small and goes with the tasks.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return with_scores(source, model).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def with_scores(source: DataFrame, model: Model) -> DataFrame:
    """All columns of ``source``, one of which is text without nulls, and ``score``."""
    names = source.columns
    schema = fields(source, *names, score="double")

    def score(batch):
        columns = {name: batch.column(name) for name in names}
        return columns | {"score": model.scores(batch.column("text"))}

    return map_slices(source, score, schema, "text", give_back)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all columns; a null text stays null."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*rest, F.col("text").isNull().alias("_no_text")).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kept = with_scores(rows, model).where(F.col("score") < threshold)
    text = F.when(~F.col("row._no_text"), F.col("text")).alias("text")
    return kept.select("row.*", text).select(*docs.columns)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the open folds and score every document."""
    return scored(docs, train(docs, labels)).withColumn(
        "held_out", crc_fold(F.col("doc_id")) == 2
    )


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_table(docs, labels).select("doc_id", "held_out", "score", "predicted")
