"""Incremental forms: contigs that arrive as files are encoded as a stream."""
