"""Text functions on hand-written prompts, shell lines and requests."""

import difflib
import hashlib
import json
import shlex

import pytest
from pyspark.sql import functions as F

from agentrace.functions import literals as L
from agentrace.functions import phrases as P
from agentrace.functions import requests as R
from agentrace.functions.text import ascii_ratio, contains_phrase, slug, squash
from agentrace.operators import coding, library, variants


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Could you please check this?", "could_you_please"),
        ("I looked. Can you help me with it", "can_you_help_me"),
        ("hello chatgpt, write a poem", "direct_imperative"),
        ("Write a poem, please.", "please_suffix"),
        ("Write a poem, thanks in advance!", "thanks_suffix"),
        ("nice weather, thank you", "thanks_suffix"),
        ("Show me. Would you mind waiting", "would_you_mind"),
        ("Why can't you do it", "why_cant_you"),
        ("nothing here", None),
        ("I please myself", None),
    ],
)
def test_request_formats(spark, text, want):
    n = R.normalize_request(F.col("t"))
    assert one(spark, R.request_format(R.request_openings(n), R.modifiers(n)), t=text) == want


def test_normalisation(spark):
    text = "see ```x\ny``` https://a.b/c?d www.e.f  me.x+y@z.org 12345 and 1234é"
    assert one(spark, R.normalize_request(F.col("t")), t=text) == "see <CODE> <URL> <URL> <EMAIL> <NUMBER> and 1234é"


def test_word_features(spark):
    feats = one(spark, R.word_features(R.word_tokens(F.col("t"))), t="It's a URL www.x.y")
    assert feats == ["w=it's", "w=a", "w=url", "w=<url>", "b=it's_a", "b=a_url", "b=url_<url>"]
    assert one(spark, R.word_features(R.word_tokens(F.col("t"))), t="") == []


def test_tokens_and_boundary_phrases(spark):
    assert one(spark, P.tokens(F.col("t")), t="L’été 漢字 カタカナ 한국 x² a1b") == [
        "l’été", "漢", "字", "カタカナ", "한국", "x²", "a", "b",
    ]
    text = F.col("t")
    got = one(spark, P.boundary_phrases(P.tokens(text), F.transform(P.sentences(text), P.tokens)), t="Hi there. Bye")
    assert {(p.position, p.n_tokens, p.phrase) for p in got} == {
        ("prompt_start", 1, "hi"), ("prompt_start", 2, "hi there"), ("prompt_start", 3, "hi there bye"),
        ("prompt_end", 1, "bye"), ("prompt_end", 2, "there bye"), ("prompt_end", 3, "hi there bye"),
        ("sentence_start", 1, "hi"), ("sentence_start", 2, "hi there"), ("sentence_start", 1, "bye"),
        ("sentence_end", 1, "there"), ("sentence_end", 2, "hi there"), ("sentence_end", 1, "bye"),
    }


def test_slug_squash_contains_ascii(spark):
    assert one(spark, slug(F.col("t")), t="  Héllo World/x=1!! ") == "h_llo_world/x=1"
    assert one(spark, contains_phrase(squash(F.col("t")), F.lit("A.B")), t="x a.b y") is True
    assert one(spark, contains_phrase(squash(F.col("t")), F.lit("5")), t="item 55") is False
    assert one(spark, ascii_ratio(F.col("t")), t="aé") == 0.5
    assert one(spark, ascii_ratio(F.col("t")), t="") == 1.0


def test_literals(spark):
    text = 'Pay $1,200 by 10:30 "now", not \'later\'; mail a.b@c.org. Don\'t use v2 or ID-7 all day'
    assert one(spark, L.numeric_tokens(F.col("t")), t=text) == ["1,200", "10:30", "7"]
    assert one(spark, L.protected_strings(F.col("t")), t=text) == ["a.b@c.org", "later", "now"]
    spans = one(spark, L.locked_spans(F.col("t")), t=text)
    assert "$1,200" in spans and "1,200" not in spans and "all" in spans
    lits = L.protected_literals(F.col("t"))
    assert one(spark, L.restore_literals(L.shield_literals(F.col("t"), lits), lits), t=text) == text
    lower = F.lower(L.shield_literals(F.col("t"), lits))
    assert one(spark, L.restore_literals(lower, lits), t="Pay $1,200 on \\n10") == "pay $1,200 on \\n10"
    code = "Run `a b` with --fast on /etc/x.conf, my_fn() and $HOME"
    masked = L.mask_text(F.col("t"))
    assert one(spark, masked, t=code) == "Run ⟦0⟧ with ⟦1⟧ on ⟦2⟧, ⟦3⟧() and ⟦4⟧"
    assert one(spark, L.unmask_text(masked, L.mask_spans(F.col("t"))), t=code) == code
    assert one(spark, L.unmask_text(F.lit("⟦0⟧ ⟦0⟧"), L.mask_spans(F.col("t"))), t="`a`") is None


def test_sentences_and_permutation(spark):
    text = "Ask Dr. Who. Then go! \"Quoted\" end. lower stays"
    assert one(spark, variants.split_sentences(F.col("t")), t=text) == [
        "Ask Dr. Who.", "Then go!", "\"Quoted\" end. lower stays",
    ]
    assert one(spark, variants.context_to_end(F.col("t")), t=" First one.\nSecond. ") == "Second. First one.\n"
    assert one(spark, variants.context_to_end(F.col("t")), t="A. B\nC") == "B\nC\n\nA.\n"
    assert one(spark, variants.context_to_end(F.col("t")), t="only one.") is None
    got = one(spark, variants.seeded_permutation(F.split("t", " "), F.lit("k")), t="a b c d")
    assert sorted(got) == list("abcd") and got != list("abcd")


def test_shell_commands(spark):
    line = "cd /app && sudo FOO=1 python3 -m pip install x; sed -i 's/a/b/' f.py | grep \"two words\" n.txt\n/usr/bin/git status; echo 'open"
    got = one(spark, coding.shell_commands(F.col("t")), t=line)
    assert got == [
        ["python3", "-m", "pip", "install", "x"], ["sed", "-i", "s/a/b/", "f.py"], ["grep", "two words", "n.txt"],
        ["/usr/bin/git", "status"], ["echo", "'open"],
    ]
    kinds = one(spark, F.transform(coding.shell_commands(F.col("t")), coding.classify), t=line)
    assert kinds == ["install", "write", "read", "vcs", "read"]
    assert one(spark, coding.paths(F.col("t")), t="a/b.py 1.5 /x/y, z.txt") == ["/x/y", "a/b.py", "z.txt"]
    assert one(spark, coding.shell_commands(F.col("t")), t="cd x") == []
    for line in (r'echo "a \"b\" \\ \n" \"x\" y\ z', "p 'a \\\" b'\"c\"\\'d", 'e "" f'):
        assert one(spark, coding.shell_commands(F.col("t")), t=line) == [shlex.split(line)]


def test_call_keys_are_digests_of_canonical_records(spark):
    records = [("t", {"b": "1", 'a"\\': '"x"'}), (None, {}), ("ü|", {"é": "null"}), ("", {"k": "1.5"})]
    rows = spark.createDataFrame(records, "tool string, args map<string,string>")
    got = rows.select("tool", library.call_key(F.col("tool"), library.canonical_map(F.col("args"))).alias("key")).collect()
    for (tool, args), row in zip(records, got):
        record = {"tool_id": tool, "arguments": {k: json.loads(v) for k, v in args.items()}}
        text = json.dumps(record, sort_keys=True, ensure_ascii=False)
        assert row.key == hashlib.sha256(text.encode()).hexdigest()


def test_surface_guards(spark):
    rows = [
        ("t", "Can you send $5 to Ann?", "Can you send $5 to Ann?"),
        ("t", "Can you send $5 to Ann?", "Never send it to Bob."),
        ("t", "Please send $5 to Ann today", "Please send $5 to Ann this day"),
    ]
    df = spark.createDataFrame(rows, "task_id string, s string, c string")
    got = variants.surface_guards(df, "s", "c").collect()
    assert got[0].failures == ["identity"]
    assert {"missing_protected_literal", "question_force_changed", "negation_or_scope_marker_changed"} <= set(got[1].failures)
    assert got[2].passed
    want = difflib.SequenceMatcher(None, "please send to ann today", "please send to ann this day").ratio()
    assert abs(got[2].surface_similarity - want) < 1e-12


def test_outputs_with_escaped_error_members_are_not_usable(spark):
    from agentrace.operators.library import usable_response

    texts = ['{"\\u0065rror": "x"}', '{"err\\u006frs": [1]}', '{"error": null}', '{"v": "error"}', "plain", '{"v": 1}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", usable_response(F.col("t"), F.lit(None).cast("string")).alias("u")).collect()
    assert {r.i: r.u for r in found} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True, 6: False}
