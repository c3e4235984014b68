"""Structured Streaming forms of the recurrences, the aligner and the block quantiser."""
