"""Readers and writers of documents, page images and metrics."""
