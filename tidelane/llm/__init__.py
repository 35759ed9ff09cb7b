"""Operators of a training-data pipeline: classifiers, deduplication, decontamination, scans, tokens."""
