"""Consistency analytics over agent execution logs, built on PySpark DataFrames."""

from agentrace.session import build_session

__all__ = ["build_session"]
