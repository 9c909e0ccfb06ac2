"""Shared plan helpers and the registry of named queries (``catalog``)."""
