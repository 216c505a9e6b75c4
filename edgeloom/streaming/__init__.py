"""Incremental components over a stream of edges."""
