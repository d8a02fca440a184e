"""Readers for the tables the queries work on."""

from tidemark.sources.tables import load, release, settled, shared_dir, spread

__all__ = ["load", "release", "settled", "shared_dir", "spread"]
