"""Snapshots of an unbounded stream of edges."""
