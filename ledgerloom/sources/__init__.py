"""Readers, writers and adapters over the driver test tables."""
