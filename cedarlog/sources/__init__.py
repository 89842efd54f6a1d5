"""Readers and writers: raw lines, tables, rendered lines, and the event feed."""
