"""Log analytics on Spark: parse, mask, template, store, search and score logs."""

__version__ = "0.1.0"
