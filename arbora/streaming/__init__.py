"""Incremental indexing of arriving documents."""
