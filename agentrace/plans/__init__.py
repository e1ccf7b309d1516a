"""Query plans by theme. ``load_all`` imports every theme and returns the registry."""

from importlib import import_module

THEMES = (
    "similarity",
    "consequences",
    "corpus",
    "variants",
    "judging",
    "campaign",
    "library",
    "incremental",
    "experiment",
)


def load_all():
    for theme in THEMES:
        import_module(f"agentrace.plans.{theme}")
    from agentrace.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
