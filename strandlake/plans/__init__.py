"""The registered queries of the engine over the genome view of the driver tables, and their DuckDB oracles."""

from __future__ import annotations

from . import catalog_queries, codec_queries, kmer_queries, packing_queries, segment_queries

_PARTS = (catalog_queries, kmer_queries, segment_queries, codec_queries, packing_queries)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
