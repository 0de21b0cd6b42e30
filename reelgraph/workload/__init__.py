"""Named queries over the benchmark tables, each with the SQL that states its expected result."""

from __future__ import annotations


def load_all():
    """Import every query module so that the registry is complete."""
    from reelgraph.workload import (  # noqa: F401
        cluster, conversations, graphs, ingest, media, metadata, retrieval, scalars, upkeep, vectors,
    )
    from reelgraph.workload.registry import REGISTRY

    return REGISTRY
