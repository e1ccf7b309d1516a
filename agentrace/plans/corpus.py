"""Queries over the conversation corpus and the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.functions import phrases as P
from agentrace.functions import requests as R
from agentrace.functions.rows import explode_once
from agentrace.operators import bayes, corpus, stats
from agentrace.operators.ordered import global_rank
from agentrace.plans.registry import query
from agentrace.session import materialize
from agentrace.sources.tables import pick, table

MIN_COUNT = 5
TOP_N = 50_000
PAGES, PAGE_SIZE, SEED = 50, 100, 7


def q(text: str) -> str:
    return text.replace("'", "''")


DECORATE = """CASE (conv_id + turn) % 8 WHEN 0 THEN 'Could you please ' || text WHEN 1 THEN 'Can you help me ' || text
  WHEN 2 THEN text || ', thanks.' WHEN 3 THEN 'Please ' || text WHEN 4 THEN 'Why can''t you ' || text
  WHEN 5 THEN text || ' see https://x.io/a?b=1 and a.b@c.org' WHEN 6 THEN 'Hello, write ' || text || ' ref 1234567, please' ELSE text END"""


def normalize_sql(x: str) -> str:
    for pattern, token in R.PLACEHOLDERS:
        x = f"regexp_replace({x}, '{q(pattern)}', '{token}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


TURNS = f"""dec AS (SELECT conv_id, turn, role, (['en','de','fr','es'])[conv_id % 4 + 1] AS language, conv_id % 11 = 3 AS toxic, {DECORATE} AS text FROM conversations),
turns AS (SELECT * FROM dec UNION ALL SELECT conv_id, turn + 1000, role, language, toxic, replace(text, 'e', 'E') FROM dec WHERE conv_id % 10 = 0),
norm AS (SELECT *, {normalize_sql("text")} AS normalized FROM turns WHERE role = 'user')"""

MODS = ", ".join(
    f"CASE WHEN regexp_matches(normalized, '(?i){q(p)}') THEN '{n}' END"
    for n, p in (
        ("greeting_prefix", R.GREETING),
        ("please_suffix", R.SUFFIX_PLEASE),
        ("thanks_suffix", R.SUFFIX_THANKS),
    )
)
OPENING = "CASE " + " ".join(
    f"WHEN regexp_matches(normalized, '(?i){q(R.LEAD + p)}') THEN '{n}'" for n, _, _, p, _ in R.FORMATS
) + " END"


def formats_sql(source: str, name: str) -> str:
    return f"""{name}_m AS (SELECT *, list_filter([{MODS}], lambda m: m IS NOT NULL) AS modifiers, {OPENING} AS opening FROM {source}),
{name} AS (SELECT * EXCLUDE (opening), CASE WHEN opening IS NULL OR opening = 'direct_imperative' THEN
   CASE WHEN list_contains(modifiers, 'please_suffix') THEN 'please_suffix' WHEN list_contains(modifiers, 'thanks_suffix') THEN 'thanks_suffix' ELSE opening END
   ELSE opening END AS format_id FROM {name}_m)"""


def conversation_turns(spark, sf_dir) -> DataFrame:
    return decorate(table(spark, sf_dir, "conversations"))


def decorate(t: DataFrame) -> DataFrame:
    """Turns with language and toxicity, request phrases added by turn, and copies that differ
    in case only."""
    text, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 8
    decorated = (
        F.when(k == 0, F.concat(F.lit("Could you please "), text))
        .when(k == 1, F.concat(F.lit("Can you help me "), text))
        .when(k == 2, F.concat(text, F.lit(", thanks.")))
        .when(k == 3, F.concat(F.lit("Please "), text))
        .when(k == 4, F.concat(F.lit("Why can't you "), text))
        .when(k == 5, F.concat(text, F.lit(" see https://x.io/a?b=1 and a.b@c.org")))
        .when(k == 6, F.concat(F.lit("Hello, write "), text, F.lit(" ref 1234567, please")))
        .otherwise(text)
    )
    base = t.select(
        "conv_id",
        "turn",
        "role",
        pick(("en", "de", "fr", "es"), (F.col("conv_id") % 4).cast("int")).alias("language"),
        (F.col("conv_id") % 11 == 3).alias("toxic"),
        decorated.alias("text"),
    )
    copies = base.filter(F.col("conv_id") % 10 == 0).withColumns(
        {"turn": F.col("turn") + 1000, "text": F.replace(F.col("text"), F.lit("e"), F.lit("E"))}
    )
    return base.unionByName(copies)


@query(
    "first_user_turn",
    f"WITH {TURNS} SELECT conv_id, min(turn) AS turn, arg_min(language, turn) AS language, arg_min(text, turn) AS text FROM norm GROUP BY conv_id",
)
def first_user_turn(spark, sf_dir):
    return corpus.first_user_turn(conversation_turns(spark, sf_dir)).select("conv_id", "turn", "language", "text")


@query("normalize_text", f"WITH {TURNS} SELECT conv_id, turn, normalized FROM norm")
def normalize_text(spark, sf_dir):
    users = conversation_turns(spark, sf_dir).filter(F.col("role") == "user")
    return corpus.with_normalized(users).select("conv_id", "turn", "normalized")


DEDUP = f"""{TURNS}, dig AS (SELECT *, sha256(lower(normalized)) AS digest, row_number() OVER (PARTITION BY sha256(lower(normalized)) ORDER BY conv_id, turn) AS rn,
  count(*) OVER (PARTITION BY sha256(lower(normalized))) AS copies FROM norm WHERE normalized <> ''),
uniq AS (SELECT digest, conv_id, turn, language, normalized, copies FROM dig WHERE rn = 1)"""


@query("dedup_turns", f"WITH {DEDUP} SELECT digest, conv_id, turn, language, normalized, copies FROM uniq")
def dedup_turns(spark, sf_dir):
    return corpus.dedup_turns(conversation_turns(spark, sf_dir)).select(
        "digest", "conv_id", "turn", "language", "normalized", "copies"
    )


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{q(P.TOKEN)}'), lambda t: lower(t))"


@query(
    "multilingual_tokens",
    f"""WITH {TURNS}, t AS (SELECT language, unnest({tok("normalized")}) AS token FROM norm)
    SELECT language, token, count(*) AS n FROM t GROUP BY ALL""",
)
def multilingual_tokens(spark, sf_dir):
    users = corpus.with_normalized(conversation_turns(spark, sf_dir).filter(F.col("role") == "user"))
    return (
        explode_once(users, P.tokens(F.col("normalized")), "token", "language")
        .groupBy("language", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


PHRASES = f"""{DEDUP},
segs AS (
  SELECT conv_id, turn, language, 'prompt' AS p, {tok("normalized")} AS t FROM uniq
  UNION ALL SELECT conv_id, turn, language, 'sentence', {tok("s")} FROM (
    SELECT conv_id, turn, language, unnest((list_filter(list_transform(string_split(regexp_replace(normalized, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s)), lambda s: s <> ''))) AS s FROM uniq)),
ph AS (
  SELECT DISTINCT conv_id, turn, language, p || '_start' AS position, n::INTEGER AS n_tokens, array_to_string(t[1:n], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, least(8, len(t)) + 1)) AS n FROM segs)
  UNION SELECT DISTINCT conv_id, turn, language, p || '_end', n::INTEGER, array_to_string(t[len(t) - n + 1:len(t)], ' ')
    FROM (SELECT *, unnest(range(1, least(6, len(t)) + 1)) AS n FROM segs)),
pc AS (SELECT language, position, n_tokens, phrase, count(*) AS turn_count FROM ph GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
rk AS (SELECT *, row_number() OVER (ORDER BY turn_count DESC, language, position, n_tokens, phrase) AS frequency_rank FROM pc)"""


def phrase_table(spark, sf_dir):
    return corpus.phrase_counts(corpus.dedup_turns(conversation_turns(spark, sf_dir)), MIN_COUNT)


@query("boundary_phrase_counts", f"WITH {PHRASES} SELECT * FROM pc")
def boundary_phrase_counts(spark, sf_dir):
    return phrase_table(spark, sf_dir)


@query("phrase_rank", f"WITH {PHRASES} SELECT * FROM rk")
def phrase_rank(spark, sf_dir):
    return global_rank(phrase_table(spark, sf_dir), corpus.frequency_order(), "frequency_rank")


@query("phrase_rank_topn", f"WITH {PHRASES} SELECT language, position, n_tokens, phrase, turn_count FROM rk WHERE frequency_rank <= {TOP_N}")
def phrase_rank_topn(spark, sf_dir):
    return phrase_table(spark, sf_dir).orderBy(*corpus.frequency_order()).limit(TOP_N)


@query(
    "corpus_counters",
    f"""WITH {DEDUP}, a AS (SELECT language, count(*) AS user_turns, count(*) FILTER (normalized = '') AS empty_turns FROM norm GROUP BY ALL),
    b AS (SELECT language, count(*) AS unique_turns, count(*) FILTER (len(regexp_extract_all(normalized, '{q(P.TOKEN)}')) > 0) AS tokenised_turns FROM uniq GROUP BY ALL)
    SELECT language, user_turns, empty_turns, coalesce(unique_turns, 0) AS unique_turns, coalesce(tokenised_turns, 0) AS tokenised_turns,
      user_turns - empty_turns - coalesce(unique_turns, 0) AS duplicate_turns FROM a LEFT JOIN b USING (language)""",
)
def corpus_counters(spark, sf_dir):
    return corpus.corpus_counters(conversation_turns(spark, sf_dir))


FIRST = f"""{TURNS}, firstn AS (SELECT conv_id, min(turn) AS turn, arg_min(language, turn) AS language, arg_min(toxic, turn) AS toxic,
  arg_min(normalized, turn) AS normalized FROM norm GROUP BY conv_id),
{formats_sql("firstn", "ff")}, fw AS (SELECT *, len(string_split(normalized, ' ')) AS n_words FROM ff)"""


@query(
    "request_format_detection",
    f"WITH {TURNS}, {formats_sql('norm', 'nf')} SELECT conv_id, turn, array_to_string(modifiers, '|') AS modifiers, format_id FROM nf",
)
def request_format_detection(spark, sf_dir):
    users = corpus.with_normalized(conversation_turns(spark, sf_dir).filter(F.col("role") == "user"))
    return corpus.with_format(users).select(
        "conv_id", "turn", F.array_join("modifiers", "|").alias("modifiers"), "format_id"
    )


@query(
    "request_counters",
    f"""WITH {FIRST} SELECT count(*) AS first_user_turns, count(*) FILTER (language = 'en') AS english_first_user_turns,
      count(*) FILTER (language = 'en' AND toxic) AS toxic_skipped,
      count(*) FILTER (language = 'en' AND NOT toxic AND NOT n_words BETWEEN 3 AND 120) AS length_skipped,
      count(*) FILTER (language = 'en' AND NOT toxic AND n_words BETWEEN 3 AND 120 AND format_id IS NULL) AS unmatched_english_turns,
      count(*) FILTER (language = 'en' AND NOT toxic AND n_words BETWEEN 3 AND 120 AND format_id IS NOT NULL) AS matched_request_turns FROM fw""",
)
def request_counters(spark, sf_dir):
    return corpus.request_counters(first_turns(spark, sf_dir))


def first_turns(spark, sf_dir):
    first = corpus.first_user_turn(conversation_turns(spark, sf_dir))
    return corpus.with_format(corpus.with_normalized(first))


def labelled_documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "text",
        label.alias("label"),
        label.cast("double").alias("score"),
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("source"),
    )


WORD_SQL = f"regexp_extract_all(lower({normalize_sql('text')}), '{q(R.WORD)}')"
LABELLED = f"""lab AS (SELECT d.doc_id, text, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS label,
  CASE WHEN d.doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM documents d JOIN labels USING (doc_id)),
ltok AS (SELECT doc_id, label, source, {WORD_SQL} AS t FROM lab),
lfeat AS (SELECT doc_id, label, source, f AS feature, count(*) AS freq FROM (
  SELECT doc_id, label, source, unnest(list_concat([ 'w=' || x for x in t ], [ 'b=' || t[i] || '_' || t[i + 1] for i in range(1, len(t)) ])) AS f FROM ltok) GROUP BY ALL)"""


def nb_sql(train_docs: str, train_feat: str, test_ids: str, test_feat: str) -> str:
    return f"""
cnt AS (SELECT feature, sum(freq) FILTER (label = -1) AS m, sum(freq) FILTER (label = 0) AS z, sum(freq) FILTER (label = 1) AS o FROM {train_feat} GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM {train_docs}) AS nd, (SELECT count(*) FROM {train_docs} WHERE label = -1) AS dm, (SELECT count(*) FROM {train_docs} WHERE label = 0) AS dz,
  (SELECT count(*) FROM {train_docs} WHERE label = 1) AS dn, count(*) AS v, coalesce(sum(m), 0) AS tm, coalesce(sum(z), 0) AS tz, coalesce(sum(o), 0) AS tn FROM cnt),
agg AS (SELECT f.doc_id, sum(f.freq) AS n, sum(f.freq * ln(coalesce(m, 0) + 1)) AS sm, sum(f.freq * ln(coalesce(z, 0) + 1)) AS sz, sum(f.freq * ln(coalesce(o, 0) + 1)) AS so
  FROM {test_feat} f LEFT JOIN cnt USING (feature) GROUP BY ALL),
sc AS (SELECT i.*, ln(dm / nd) + coalesce(sm, 0) - coalesce(n, 0) * ln(tm + v) AS score_m1, ln(dz / nd) + coalesce(sz, 0) - coalesce(n, 0) * ln(tz + v) AS score_0,
  ln(dn / nd) + coalesce(so, 0) - coalesce(n, 0) * ln(tn + v) AS score_1 FROM {test_ids} i LEFT JOIN agg USING (doc_id), tot),
pred AS (SELECT *, CASE WHEN score_m1 >= score_0 AND score_m1 >= score_1 THEN -1 WHEN score_0 >= score_1 THEN 0 ELSE 1 END AS predicted FROM sc)"""


@query(
    "nb_train",
    f"""WITH {LABELLED} SELECT feature, coalesce(sum(freq) FILTER (label = -1), 0)::BIGINT AS c_m1, coalesce(sum(freq) FILTER (label = 0), 0)::BIGINT AS c_0,
    coalesce(sum(freq) FILTER (label = 1), 0)::BIGINT AS c_1 FROM lfeat GROUP BY feature""",
)
def nb_train(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    return bayes.feature_counts(docs)


SPLIT = f"""{LABELLED},
sp AS (SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('split:' || doc_id)) - 1 < floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM lab)"""


def split_documents(spark, sf_dir):
    return stats.stratified_split(labelled_documents(spark, sf_dir), "label", "doc_id", "split:")


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, label, split FROM sp")
def stratified_split(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "label", "split")


def train_and_score(train: DataFrame, test: DataFrame) -> DataFrame:
    counts = materialize(bayes.feature_counts(train), "nb")
    totals = materialize(bayes.class_totals(train, counts), "nb-totals")
    features = bayes.document_features(test, "doc_id")
    return bayes.score(test.drop("text"), features, counts, totals, "doc_id")


HOLDOUT = f"""{SPLIT}, trd AS (SELECT * FROM sp WHERE split = 'train'), trf AS (SELECT f.* FROM lfeat f JOIN trd USING (doc_id)),
ted AS (SELECT * FROM sp WHERE split = 'test'), tef AS (SELECT f.doc_id, f.feature, f.freq FROM lfeat f JOIN ted USING (doc_id)), {nb_sql("trd", "trf", "ted", "tef")}"""


@query(
    "nb_predict",
    f"WITH {HOLDOUT} SELECT doc_id, label, round(score_m1, 6) AS score_m1, round(score_0, 6) AS score_0, round(score_1, 6) AS score_1, predicted FROM pred",
)
def nb_predict(spark, sf_dir):
    docs = materialize(split_documents(spark, sf_dir), "split")
    scored = train_and_score(docs.filter(F.col("split") == "train"), docs.filter(F.col("split") == "test"))
    return scored.select(
        "doc_id", "label", *[F.round(c, 6).alias(c) for c in ("score_m1", "score_0", "score_1")], "predicted"
    )


METRICS = """SELECT count(*) AS n, {cells}, avg((label = predicted)::INTEGER) AS accuracy FROM pred"""
CELLS = ", ".join(
    f"count(*) FILTER (label = {a} AND predicted = {b}) AS gold_{na}_pred_{nb}"
    for a, na in ((-1, "m1"), (0, "0"), (1, "1"))
    for b, nb in ((-1, "m1"), (0, "0"), (1, "1"))
)


def f1_sql(lab: str) -> str:
    others = [x for x in ("m1", "0", "1") if x != lab]
    wrong = " + ".join(f"gold_{o}_pred_{lab} + gold_{lab}_pred_{o}" for o in others)
    tp = f"gold_{lab}_pred_{lab}"
    return f"CASE WHEN {tp} > 0 THEN 2 * {tp} / (2 * {tp} + {wrong}) ELSE 0 END"


def metrics_sql(pred: str = "pred") -> str:
    return f"""SELECT *, round(({f1_sql("m1")} + {f1_sql("0")} + {f1_sql("1")}) / 3, 9) AS macro_f1 FROM (
      SELECT count(*) AS n, {CELLS}, round(avg((label = predicted)::INTEGER), 9) AS accuracy FROM {pred})"""


@query("classification_metrics", f"WITH {HOLDOUT} {metrics_sql()}")
def classification_metrics(spark, sf_dir):
    docs = materialize(split_documents(spark, sf_dir), "split")
    scored = train_and_score(docs.filter(F.col("split") == "train"), docs.filter(F.col("split") == "test"))
    return bayes.classification_metrics(scored)


CROSS = f"""{LABELLED}, trd AS (SELECT * FROM lab WHERE source = 'a'), trf AS (SELECT * FROM lfeat WHERE source = 'a'),
ted AS (SELECT doc_id, label FROM lab WHERE source = 'b'), tef AS (SELECT * FROM lfeat WHERE source = 'b'), {nb_sql("trd", "trf", "ted", "tef")}"""


@query("cross_source_metrics", f"WITH {CROSS} {metrics_sql()}")
def cross_source_metrics(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    scored = train_and_score(docs.filter(F.col("source") == "a"), docs.filter(F.col("source") == "b"))
    return bayes.classification_metrics(scored)


REQUESTS = f"""{FIRST}, {LABELLED},
req AS (SELECT * FROM fw WHERE language = 'en' AND NOT toxic AND n_words BETWEEN 3 AND 120 AND format_id IS NOT NULL),
rtok AS (SELECT conv_id AS doc_id, regexp_extract_all(lower(normalized), '{q(R.WORD)}') AS t FROM req),
rfeat AS (SELECT doc_id, f AS feature, count(*) AS freq FROM (
  SELECT doc_id, unnest(list_concat([ 'w=' || x for x in t ], [ 'b=' || t[i] || '_' || t[i + 1] for i in range(1, len(t)) ])) AS f FROM rtok) GROUP BY ALL),
rid AS (SELECT conv_id AS doc_id, format_id, modifiers, n_words FROM req), {nb_sql("lab", "lfeat", "rid", "rfeat")},
cs AS (SELECT format_id, count(*) AS corpus_count, count(*) FILTER (predicted = 1) AS corpus_predicted_polite, count(*) FILTER (predicted = 0) AS corpus_predicted_neutral,
  count(*) FILTER (predicted = -1) AS corpus_predicted_impolite, count(*) FILTER (list_contains(modifiers, 'greeting_prefix')) AS greeting_prefix,
  count(*) FILTER (list_contains(modifiers, 'please_suffix')) AS please_suffix, count(*) FILTER (list_contains(modifiers, 'thanks_suffix')) AS thanks_suffix,
  quantile_cont(n_words, 0.5)::DOUBLE AS corpus_median_words FROM pred GROUP BY ALL)"""


def scored_requests(spark, sf_dir):
    turns = materialize(first_turns(spark, sf_dir), "first-turns")
    requests = corpus.eligible_requests(turns).select(
        F.col("conv_id").alias("doc_id"), "format_id", "modifiers", "n_words", F.col("normalized").alias("text")
    )
    return train_and_score(labelled_documents(spark, sf_dir), requests)


@query("request_format_frequency", f"WITH {REQUESTS} SELECT * FROM cs")
def request_format_frequency(spark, sf_dir):
    return corpus.corpus_format_stats(scored_requests(spark, sf_dir))


def labelled_requests(spark, sf_dir):
    """Labelled documents with request openings added, so that formats occur in them."""
    docs = labelled_documents(spark, sf_dir)
    opening = F.when(F.col("doc_id") % 3 == 0, "Please ").when(F.col("doc_id") % 3 == 1, "Could you ").otherwise("")
    opened = docs.withColumn("text", F.concat(opening, F.col("text")))
    return corpus.with_format(corpus.with_normalized(opened))


LABELLED_FORMATS = f"""lreq0 AS (SELECT doc_id, label, CASE WHEN doc_id % 3 = 0 THEN 'Please ' WHEN doc_id % 3 = 1 THEN 'Could you ' ELSE '' END || text AS text FROM lab),
lreq AS (SELECT doc_id, label, {normalize_sql("text")} AS normalized FROM lreq0), {formats_sql("lreq", "lf")},
ls AS (SELECT format_id, count(*) AS labelled_count, avg(label::DOUBLE) AS labelled_mean_score, count(*) FILTER (label = 1) AS labelled_polite,
  count(*) FILTER (label = 0) AS labelled_neutral, count(*) FILTER (label = -1) AS labelled_impolite FROM lf WHERE format_id IS NOT NULL GROUP BY ALL)"""


@query("labelled_format_stats", f"WITH {LABELLED}, {LABELLED_FORMATS} SELECT * REPLACE (round(labelled_mean_score, 9) AS labelled_mean_score) FROM ls")
def labelled_format_stats(spark, sf_dir):
    return corpus.labelled_format_stats(labelled_requests(spark, sf_dir))


DIMENSION = ", ".join(
    f"('{i}', '{q(t)}', '{f}', '{r}')"
    for i, t, f, r in [(i, t, f, r) for i, t, f, _, r in R.FORMATS] + list(R.SUFFIX_FORMATS)
)


@query(
    "format_library",
    f"""WITH {REQUESTS}, {LABELLED_FORMATS}, dim AS (SELECT * FROM (VALUES {DIMENSION}) v(format_id, template, family, authorization_change_risk)),
    j AS (SELECT format_id, template, family, authorization_change_risk, coalesce(corpus_count, 0) AS corpus_count,
      coalesce(corpus_predicted_polite, 0) AS corpus_predicted_polite, coalesce(corpus_predicted_neutral, 0) AS corpus_predicted_neutral,
      coalesce(corpus_predicted_impolite, 0) AS corpus_predicted_impolite, corpus_median_words, coalesce(labelled_count, 0) AS labelled_count,
      labelled_mean_score, coalesce(labelled_polite, 0) AS labelled_polite, coalesce(labelled_neutral, 0) AS labelled_neutral, coalesce(labelled_impolite, 0) AS labelled_impolite
      FROM dim LEFT JOIN cs USING (format_id) LEFT JOIN ls USING (format_id))
    SELECT * REPLACE (round(labelled_mean_score, 9) AS labelled_mean_score),
      CASE WHEN labelled_count >= 10 THEN CASE WHEN labelled_mean_score >= 0.15 THEN 'polite' WHEN labelled_mean_score <= -0.15 THEN 'impolite' ELSE 'neutral' END
        WHEN corpus_count > 0 THEN CASE WHEN corpus_predicted_polite >= corpus_predicted_neutral AND corpus_predicted_polite >= corpus_predicted_impolite THEN 'polite'
          WHEN corpus_predicted_neutral >= corpus_predicted_impolite THEN 'neutral' ELSE 'impolite' END
        ELSE 'unclassified' END AS assigned_class FROM j""",
)
def format_library(spark, sf_dir):
    stats_ = corpus.corpus_format_stats(scored_requests(spark, sf_dir)).drop(
        "greeting_prefix", "please_suffix", "thanks_suffix"
    )
    labelled = corpus.labelled_format_stats(labelled_requests(spark, sf_dir))
    return corpus.format_library(corpus.format_dimension(spark), stats_, labelled)


@query(
    "top_forms_per_tone",
    f"""WITH {TURNS}, {formats_sql('norm', 'nf')}, dim AS (SELECT * FROM (VALUES {DIMENSION}) v(format_id, template, family, authorization_change_risk)),
    c AS (SELECT family, format_id, count(*) AS n FROM nf JOIN dim USING (format_id) GROUP BY ALL)
    SELECT family, format_id, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, format_id) AS rank FROM c QUALIFY rank <= 5""",
)
def top_forms_per_tone(spark, sf_dir):
    from pyspark.sql import Window

    users = corpus.with_format(
        corpus.with_normalized(conversation_turns(spark, sf_dir).filter(F.col("role") == "user"))
    )
    counts = users.groupBy("format_id").agg(F.count(F.lit(1)).alias("n")).join(
        corpus.format_dimension(spark).select("format_id", "family"), "format_id"
    )
    w = Window.partitionBy("family").orderBy(F.desc("n"), "format_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)


@query(
    "page_sample",
    f"""WITH n AS (SELECT count(*) AS total FROM documents), s AS (SELECT greatest(0, total - {PAGE_SIZE}) AS top FROM n),
    p AS (SELECT i AS page, least(top, i * greatest(1, (top + 1) // {PAGES}) + ('0x' || substr(sha256('{SEED}|' || i), 1, 8))::BIGINT % greatest(1, (top + 1) // {PAGES})) AS "offset"
          FROM s, range({PAGES}) r(i))
    SELECT page, "offset", doc_id, lang FROM p JOIN documents ON doc_id >= "offset" AND doc_id < "offset" + {PAGE_SIZE}""",
)
def page_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.page_sample(docs, "doc_id", docs.count(), PAGES, PAGE_SIZE, SEED)
