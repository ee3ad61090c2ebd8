"""Named queries, grouped by subject."""

from __future__ import annotations

import importlib

MODULES = ["cleaning_queries", "feature_queries", "association_queries", "metric_queries",
           "registry_queries", "cluster_queries", "stream_queries",
           "model_queries"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def all_queries() -> dict:
    _load()
    from tessera.plans.catalog import QUERIES
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    from tessera.plans.catalog import CHECKS
    return dict(CHECKS)
