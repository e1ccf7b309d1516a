"""Imports every operator module of this subpackage, so that its queries are registered."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "alignment",
    "audio",
    "bpe",
    "licenses",
    "lines",
    "mixing",
    "neighbours",
    "secrets",
    "similarity",
    "sketches",
    "toxicity",
    "trie",
    "wrappers",
)


def load():
    for name in MODULES:
        import_module(f"agentrace.llm.{name}")
    from agentrace.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
