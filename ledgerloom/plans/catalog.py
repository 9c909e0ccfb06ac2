"""Import every catalog module so all queries are registered."""
from __future__ import annotations

from . import catalog_edges, catalog_evaluate, catalog_extra, catalog_graph, catalog_misc, catalog_streaming, catalog_tasks, catalog_features, catalog_ingest, catalog_quality, catalog_temporal  # noqa: F401
from .registry import REGISTRY


def queries():
    return {name: q.spark for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
