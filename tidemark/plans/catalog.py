"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from . import actions, audit, clusters, content, feed, history, orders, readmodel, registry, runs, scalars, search, similarity, snapshots, sources, streams, whole  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
