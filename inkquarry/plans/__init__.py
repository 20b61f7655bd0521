"""Whole flows: documents to stored series, and the registered queries."""
