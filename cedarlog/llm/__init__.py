"""Operators for training-data corpora: deduplication, filtering, extraction, decontamination, mixing."""
