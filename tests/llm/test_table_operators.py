"""Pages, joins, mixing, neighbours, toxicity and the pipeline against plain versions of themselves."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from helpers import SCHEMA, awkward, awkward_texts, empty, prose, rows_of, shingles, smallest_linked, words
from pyspark.sql import functions as F

import corpus_pipeline
from agentrace.llm import mixing, neighbours, similarity, toxicity, wrappers

PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class="ad">buy</div>
<article><h1>{t}</h1>{body}</article><div id="comments"><p>first!</p></div>
<form><label>mail</label></form><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def page(title, paragraphs, cut=0):
    menu = "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(1 + len(paragraphs) % 4))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    text = PAGE.format(t=title, menu=menu, body=body)
    return text[: len(text) - cut]


def test_main_text_of_pages(spark):
    rows, expected = [], {}
    for i in range(40):
        paras = [f"p{i} {k} a &amp; b<br>c" for k in range(i % 7)]
        if i % 5 == 0:
            paras.insert(0, "<b>bold</b>  start")
        rows.append((i, f"http://H{i % 2}.example.org/{i}", page(f"T {i}", paras, 20 * (i % 3 == 0)), "w"))
        plain = [p.replace("&amp;", "&").replace("<br>", " ").replace("<b>", "").replace("</b>", "") for p in paras]
        expected[i] = "\n\n".join([f"T {i}"] + [" ".join(p.split()) for p in plain])
    rows += [(100, None, None, "w"), (101, "x", "", "w"), (102, None, "just text <b>here</b>", "w"), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == expected.get(r.page_id, {100: "", 101: "", 102: "just text here"}.get(r.page_id))
    assert wrappers.extract(pages.where("page_id < 0")).count() == 0


def test_wrappers_generalise_over_repeats_and_missing_parts():
    streams = [wrappers.folded(wrappers.page_tokens(page("t", ["x"] * n))[0]) for n in (1, 0, 4)]
    whole = streams[0]
    for s in streams[1:]:
        whole = wrappers.folded(wrappers.aligned(whole, s))
    assert '{"*":["p",' in wrappers.dumped(whole).replace('"?"', '"*"')
    again = wrappers.loaded(wrappers.dumped(whole))
    assert wrappers.dumped(again) == wrappers.dumped(whole)
    # Text in a menu of links is no main text on a page without article.
    bare = "<div><a href=a>one</a></div><section><p>long text of the page</p></section>"
    items = wrappers.folded(wrappers.page_tokens(bare)[0])
    assert wrappers.main_text(bare, wrappers.dumped(items)) == "long text of the page"


@pytest.mark.parametrize(
    "hidden",
    [
        "<!-- <main> -->", "<script>var x = '<article>'</script>", "<noscript><main>no</main></noscript>",
        "<template><article></article></template>", "<main-menu></main-menu>",
    ],
)
def test_an_article_in_skipped_parts_is_none(spark, hidden):
    body = "<nav>menu</nav><div><p>text {} of the page</p></div>"
    rows = [(i, f"http://h{i % 2}/{i}", hidden + body.format(i)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got == {i: f"text {i} of the page" for i in range(3)}
    # A real one counts, also if it comes after other text.
    html = f"{hidden}<p>before</p><main><p>inside</p></main>"
    assert wrappers.main_text(html, None) == "inside"


def test_repeats_of_any_length_fold():
    card = "<div><h2>a</h2><h3>b</h3><h4>c</h4><h5>d</h5><h6>e</h6><section>f</section></div>"
    found = [wrappers.folded(wrappers.page_tokens(f"<main>{card * n}</main>")[0]) for n in (2, 3, 8)]
    assert len({tuple(map(wrappers.shape, items)) for items in found}) == 1
    assert [x.op for x in found[0] if isinstance(x, wrappers.Group)] == ["+"]
    assert [len(s.at) for s in wrappers.slots(found[2])] == [8] * 6
    rng = np.random.default_rng(6)
    for n in range(1, 40):
        for names in (1, 2, 3):
            for ids in rng.integers(0, names + 1, (6, n)).tolist():
                ids += ids[n // 2 :] * (n % 2)
                for unit in range(1, len(ids) // 2 + 1):
                    starts = range(len(ids) - 2 * unit + 1)
                    expected = any(ids[i : i + unit] == ids[i + unit : i + 2 * unit] for i in starts)
                    assert wrappers.repeats(ids, unit) == expected


def near_copies():
    base = prose(9, 200, 5000)
    out = [base]
    for i in range(40):
        w = base.split()
        for k in range(i % 5):
            w[(31 * i + 47 * k) % 200] = f"new{i}x{k}"
        out.append(" ".join(w))
    return out + [prose(20 + i, 40, 60) for i in range(10)] + [" ".join(["same"] * n) for n in (3, 4, 90)]


@pytest.mark.parametrize("width, percent, small", [(3, 90, False), (5, 80, False), (3, 90, True)])
def test_jaccard_components(spark, monkeypatch, width, percent, small):
    if small:  # long slabs and components of several blocks
        monkeypatch.setattr(similarity, "TREE_ROWS", 5)
        monkeypatch.setattr(similarity, "BLOCK", 7)
    texts = awkward_texts() + near_copies()
    docs = spark.createDataFrame(rows_of(texts, first=0), SCHEMA)
    expected, sets = smallest_linked(texts, width, percent)
    for r in similarity.jaccard_components(docs, width, percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id]), r
        assert r.stays == (r.doc_id == expected[r.doc_id])


def test_sets_without_twins_are_not_dealt_to_blocks(spark, monkeypatch):
    """Sets of a large component that can link with none are sent once, not once a block."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "BUCKET_SHINGLES", 300)
    base = prose(1, 200, 10**6)
    near = [base, base + " tail", "head " + base]
    texts = [*near, *[prose(10 + i, 200, 10**6) for i in range(20)], "few words", "few words more"]
    sets = [(int(i > 22), bytes([i] * 16), len(shingles(t, 3)), zstandard.compress(t.encode())) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(sets, "label int, set binary, n long, packed binary")
    left = {r["set"][0]: r for r in similarity.to_verify(rows, 3, 90).collect()}
    assert sorted(left) == [0, 1, 2, 23, 24]
    assert {r["blocks"] for r in left.values()} == {1}
    assert all(len(r["shingles"]) == 8 * sets[i][2] for i, r in left.items())


def test_jaccard_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = similarity.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id is None} == {9}
    kept = similarity.one_of_each(docs)
    assert kept.columns == docs.columns
    assert similarity.jaccard_components(empty(spark)).count() == 0


def test_tree_keeps_every_linked_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 30, size=(20, similarity.LEAST_CELLS))
    points = np.repeat(base, 12, axis=0) + (rng.random((240, similarity.LEAST_CELLS)) < 0.05)
    size = points.sum(axis=1)
    union = similarity.Tree(points, size, 90).pairs()
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    for i, j in zip(*np.nonzero(shared >= similarity.least_overlap(size[:, None] + size[None], 90))):
        assert union.find(int(i)) == union.find(int(j))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    budget, open_ = float(sum(sizes.values())), set(names)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        budget -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    texts = awkward_texts() + [prose(i, 5 + i % 40) for i in range(400)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    plan = mixing.mixing_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        assert r.size == len(words(texts[r.doc_id - 1]))
        sizes[r.source] += r.size
    expected = plain_targets(sizes)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies - int(r.rate + 1e-12) <= 1 and r.taken <= 3 * r.size
    emitted = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert emitted == Counter({r.doc_id: r.copies for r in plan if r.copies})
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixing_plan(awkward(spark)).count() == awkward(spark).count()
    assert mixing.mixing_plan(empty(spark)).count() == 0


def test_neighbours_are_exact_at_factor_one(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 12)).astype(np.float32) * rng.uniform(0.2, 3, size=(900, 1)).astype(np.float32)
    v[300:500] = v[300]  # ties
    rows = [(i, x.tolist(), "c", 0.5) for i, x in enumerate(v)]
    rows += [(900, None, "c", 0.5), (901, [], "c", 0.5), (902, [0.0] * 12, "c", 0.5)]
    rows += [(903, [float("nan")] * 12, "c", 0.5), (904, [None] * 12, "c", 0.5), (None, rows[1][1], "c", 0.5)]
    rows += [(905, [1.0, 2.0], "c", 0.5), rows[7], rows[40]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, score double")
    found = neighbours.nearest(table, table.where("vec_id % 20 = 0"), factor=1.0, shard_rows=200, block_queries=20)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    d = v.astype(np.float64)
    for q, hits in got.items():
        score = np.cumsum(d * d[q], axis=1)[:, -1]
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert hits == [(k + 1, i, score[i]) for k, i in enumerate(best)]
    few = table.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.nearest(few.where("vec_id < 0"), few).count() == 0


def test_repeats_inside_a_tied_group_take_no_place(spark):
    v = np.random.default_rng(3).normal(size=(60, 6))
    v[:30] = 3 * v[0]
    ids = np.arange(60)

    def found(copies, asked):
        row = np.repeat(ids, copies)
        at, hits, _ = neighbours.shard_neighbours(row, v[row], asked, v[asked], 20, 1.0)
        return [hits[at == i].tolist() for i in range(len(asked))]

    twice, first_often = np.full(60, 2), np.where(ids == 0, 3, 1)
    for copies in (np.ones(60, int), twice, first_often, 7 * twice):
        assert found(copies, np.array([0, 7, 29])) == [
            list(range(1, 21)), [i for i in range(21) if i != 7], list(range(20)),
        ]
    rows = [(int(i), v[i].tolist()) for i in ids] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id = 7"), factor=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 7]


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    ids, asked = np.arange(3000), np.arange(0, 3000, 20)
    at, found, _ = neighbours.shard_neighbours(ids, v, asked, v[asked], 20, neighbours.FACTOR)
    score = v[asked] @ v.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    hits = sum(len(set(found[at == i]) & set(best[i])) for i in range(len(asked)))
    assert hits >= 0.9 * best.size


def labelled(spark, n=600):
    texts, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        texts.append(prose(1000 + i, 60, 900) + (" vile%d foulword" % (i % 3) if toxic else ""))
        labels.append((i, 1, int(toxic)) if i % 2 == 0 else (i + 10_000, 1, 1))
    docs = spark.createDataFrame(rows_of(texts, first=0), SCHEMA)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_table(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    told = {r.doc_id: r for r in rows if r.held_out}
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in told.values()]) > 0.95
    # Held-out labels play no part.
    flipped = labels.withColumn("toxic", F.when(toxicity.crc_fold(F.col("doc_id")) == 2, 1).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_table(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_toxicity_without_anything_to_learn(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score_table(docs, labels).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}
    assert toxicity.score_table(empty(spark), labels).count() == 0
    model = toxicity.train(*labelled(spark, 300))
    assert toxicity.scored(docs, model).where("score IS NULL OR isnan(score)").count() == 0
    assert toxicity.accepted(docs, model).columns == docs.columns


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    shared = "\n".join(prose(70 + i, 6) for i in range(5))
    extra = [*awkward_texts(), prose(50, 90) + "\n" + shared, shared + "\n" + prose(51, 90), *near_copies()[:6]]
    docs = docs.union(spark.createDataFrame(rows_of(extra, first=500), SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = list(corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard", "mixing", "bpe"]
    sf = str(tmp_path)

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns
    scores = {r.doc_id: r.predicted for r in toxicity.score_table(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}

    from test_text_operators import plain_dedup

    rows = sorted(((r.doc_id, r.text) for r in clean.collect()))
    deduped = stages["line_dedup"](spark, clean, sf)
    plain = plain_dedup(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in deduped.collect()} == {i: (t, len(t)) for i, t in plain.items()}

    ids = sorted(plain)
    first, _ = smallest_linked([plain[i] for i in ids], 5, 80)
    kept = stages["jaccard"](spark, deduped, sf)
    assert {r.doc_id for r in kept.collect()} == {ids[k] for k, f in enumerate(first) if k == f}

    mixed = stages["mixing"](spark, kept, sf)
    assert mixed.columns == columns
    sizes = Counter()
    for r in kept.collect():
        sizes[r.source] += len(words(r.text))
    target, expected = plain_targets(sizes), Counter()
    for r in kept.collect():
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        digest = hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()
        expected[r.doc_id] = int(rate) + (int(digest[:13], 16) / 2**52 < rate - int(rate))
    assert Counter(r.doc_id for r in mixed.collect()) == +expected

    result = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in result) == +expected
