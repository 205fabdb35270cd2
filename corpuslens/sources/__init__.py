"""Readers of record sets, catalogue snapshots and paginated registries."""
