"""Fast similarity sketches, and near duplicates against all pairs."""

import random

import numpy as np
import pytest
from helpers import SCHEMA, awkward, awkward_texts, empty, prose, rows_of, smallest_linked

from agentrace.llm import sketches

U64 = np.uint64


def members(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n).astype(U64))


def test_every_bin_is_filled_and_copies_agree():
    rng = np.random.default_rng(1)
    sets = [members(rng, n) for n in (0, 1, 2, 7, 40, 300, 5000)]
    found = sketches.sketches(sets)
    assert (found[0] == sketches.EMPTY).all() and (found[1:] != sketches.EMPTY).all()
    # A set's sketch doesn't depend on what else is in the batch.
    for s, row in zip(sets, found):
        assert (sketches.sketches([s, sets[3]])[0] == row).all()
    # All members of small sets are seen evenly: each fills about its share of the bins.
    counts = np.unique(found[3], return_counts=True)[1]
    assert len(np.unique(found[2])) >= 2 and counts.max() < 3 * sketches.BANDS * sketches.BAND / 7


@pytest.mark.parametrize("size", [3, 20, 200, 3000])
@pytest.mark.parametrize("share", [0.5, 0.85])
def test_bins_estimate_the_overlap(size, share):
    rng = np.random.default_rng(size)
    errors = []
    for _ in range(20):
        union = members(rng, size)
        rng.shuffle(union)
        both = round(share * size)
        a, b = union[: both + (size - both) // 2], np.concatenate((union[:both], union[both + (size - both) // 2 :]))
        one, two = sketches.sketches([a, b])
        errors.append((one == two).mean() - both / size)
    bins = sketches.BANDS * sketches.BAND
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(20 * bins)
    assert np.abs(errors).max() < 5 * 0.5 / np.sqrt(bins)


def altered(base, seed, changes):
    rng, w = random.Random(seed), base.split()
    for k in range(changes):
        w[rng.randrange(len(w))] = f"new{seed}x{k}"
    return " ".join(w)


def families():
    """Copies with a few changes, chains of them, and many texts that are alike but not enough."""
    base, like = prose(9, 200, 5000), prose(5, 150, 5000)
    out = [altered(base, i, i % 5) for i in range(40)]
    out += [altered(like, 100 + i, 7) for i in range(60)]
    chain = prose(12, 300, 5000).split()
    out += [" ".join(chain[i : i + 200]) for i in range(0, 100, 6)]
    out += [prose(20 + i, 40, 60) for i in range(10)] + [" ".join(["same"] * n) for n in (4, 5, 6, 90)]
    return out + [prose(3, 8, 900), prose(3, 7, 900), prose(3, 6, 900)] * 2


@pytest.mark.parametrize("width, percent", [(5, 85), (3, 90)])
def test_components_are_those_of_all_pairs(spark, width, percent):
    texts = awkward_texts() + families()
    docs = spark.createDataFrame(rows_of(texts, first=0), SCHEMA)
    expected, sets = smallest_linked(texts, width, percent)
    rows = sketches.near_duplicates(docs, width, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id]), r
        assert r.kept == (r.doc_id == expected[r.doc_id])


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = sketches.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id is None} == {9}
    kept = sketches.without_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 0
    assert sketches.near_duplicates(empty(spark)).count() == 0
