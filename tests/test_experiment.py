"""The experiment plan, its quarantine and task attributes."""

import pytest

from agentrace.operators import experiment as E

FORM = "task_id string, form string, prompt string"
SOURCES = [("AIP-1", "a"), ("ACB-2", None), ("TJB-3", "c")]


def frames(spark):
    source = spark.createDataFrame(SOURCES, "task_id string, prompt string")
    tone = spark.createDataFrame(
        [("AIP-1", "p01", "a?", True, False), ("AIP-1", "i03", "a!", True, True), ("ACB-2", "p01", None, None, None), ("gone", "p01", "x", True, False)],
        f"{FORM}, eligible_pilot boolean, context_sensitive boolean",
    )
    lang = spark.createDataFrame([("AIP-1", "lang_fr", "A", "fr", None)], f"{FORM}, language string, eligible_pilot boolean")
    order = spark.createDataFrame([("AIP-1", "o1", "b a", True), ("TJB-3", "o1", "c", False)], f"{FORM}, eligible_pilot boolean")
    formed = spark.createDataFrame([("TJB-3", "f", "cc", "s", True), ("TJB-3", "f", "cd", "s", True)], f"{FORM}, subtype string, strict_mt_eligible boolean")
    return source, tone, lang, order, formed


def test_families_decide_eligibility(spark):
    plan = E.experiment_plan(*frames(spark))
    got = {(r.task_id, r.family, r.form, r.prompt): r.strict_mt_eligible for r in plan.collect()}
    assert got == {
        ("AIP-1", "source", "source", "a"): True, ("ACB-2", "source", "source", None): True, ("TJB-3", "source", "source", "c"): True,
        ("AIP-1", "tone", "p01", "a?"): True, ("AIP-1", "tone", "i03", "a!"): False, ("ACB-2", "tone", "p01", None): False,
        ("AIP-1", "multilingual", "lang_fr", "A"): False, ("AIP-1", "information_order", "o1", "b a"): True,
        ("TJB-3", "formulation", "f", "cc"): True, ("TJB-3", "formulation", "f", "cd"): True,
    }
    some = E.experiment_plan(*frames(spark), families=("tone", "source"), datasets=["permission"])
    assert sorted((r.family, r.form) for r in some.collect()) == [("source", "source"), ("tone", "i03"), ("tone", "p01")]
    assert E.experiment_plan(*frames(spark), families=()).schema.names == plan.schema.names
    empty = E.experiment_plan(*[f.limit(0) for f in frames(spark)])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        E.experiment_plan(*frames(spark), families=("other",))


def test_gaps_name_what_a_plan_lacks(spark):
    source, *rest = frames(spark)
    gaps = E.plan_gaps(E.experiment_plan(source, *rest), source, ("source", "tone", "formulation"))
    got = {(r.task_id, r.family, r.form, r.reason) for r in gaps.collect()}
    assert {g for g in got if g[3] != "no form"} == {
        ("ACB-2", "source", "source", "no prompt"), ("ACB-2", "tone", "p01", "no prompt"), ("TJB-3", "formulation", "f", "planned twice"),
    }
    assert {g[:2] for g in got if g[3] == "no form"} == {("TJB-3", "tone"), ("AIP-1", "formulation"), ("ACB-2", "formulation")}


def test_overrides_of_other_prompts_stay_in_quarantine(spark):
    plan = E.experiment_plan(*frames(spark), families=("source", "multilingual"))
    lines = [
        (0, "AIP-1", "source", "old", "no", "s0"), (5, "AIP-1", "source", "a", "A'", "s1"),
        (1, "ACB-2", "source", None, "B'", "s2"), (2, "TJB-3", "source", "c ", "C'", "s3"), (3, "gone", "source", "z", "Z", "s4"),
    ]
    made = spark.createDataFrame(lines, "line_no long, task_id string, form string, prompt string, extracted string, system_sha256 string")
    both = E.with_overrides(plan, made)
    taken = {(r.task_id, r.prompt, r.original_prompt, r.prompt_override_sha256) for r in E.accepted(both).collect()}
    assert taken == {("AIP-1", "A'", "a", "s1"), ("ACB-2", "B'", None, "s2")}
    kept_out = {(r.task_id, r.form, r.prompt, r.override_prompt, r.reason) for r in E.conflicts(both).collect()}
    assert kept_out == {
        ("TJB-3", "source", "c", "c ", "made from a different prompt"), ("AIP-1", "lang_fr", "A", None, "no override"),
    }
    assert E.accepted(E.with_overrides(plan, made.limit(0))).count() == 0


def test_scores_keep_tasks_that_are_not_listed(spark):
    listed = spark.createDataFrame([(0, "a", "x", "d"), (1, "a", None, "e")], "line_no int, task_id string, task_type string, domain string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "task_id string, score double")
    got = E.with_task_attributes(scores, E.task_dimension(listed)).collect()
    assert {(r.task_id, r.score, r.task_category, r.domain) for r in got} == {("a", 1.0, None, "e"), ("b", 2.0, None, None), (None, 3.0, None, None)}
