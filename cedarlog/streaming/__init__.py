"""Structured Streaming forms of loading, rates and template evolution."""
