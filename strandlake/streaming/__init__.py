"""Incremental ingestion with Structured Streaming."""

from .ingest import append_stream, contig_stream

__all__ = ["append_stream", "contig_stream"]
