"""Folder ingest as a stream."""
