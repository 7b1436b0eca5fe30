"""Readers of documents, pages, repositories and folders."""
