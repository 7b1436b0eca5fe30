"""Whole pipelines: from documents, pages, folders and repositories to node tables."""
