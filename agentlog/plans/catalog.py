"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "q_roi", "q_stats", "q_users", "q_tables", "q_normalize", "q_quality", "q_vectors",
    "q_scenarios", "q_streams",
)


def load() -> None:
    for name in MODULES:
        import_module(f"agentlog.plans.{name}")
