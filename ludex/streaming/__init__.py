"""Structured Streaming forms of the ingest feeds (see ``ingest``)."""
