"""All registered queries and the SQL they must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "profile_queries", "merge_queries", "cleaning_queries", "advice_queries", "run_queries", "model_queries", "recommend_queries",
    "cluster_queries", "encoding_queries", "moment_queries",
)


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tablewright.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
