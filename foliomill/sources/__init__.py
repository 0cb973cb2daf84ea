"""Readers of documents, and business documents derived from relational tables."""
