"""Loads every module that registers queries."""

from importlib import import_module

GROUPS = ("checks_text", "checks_rules", "checks_query", "checks_runs", "checks_state", "checks_events", "checks_payloads")


def load() -> None:
    for group in GROUPS:
        import_module(f"hiretide.plans.{group}")
