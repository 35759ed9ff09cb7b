"""Keyed event-time operators over DataFrames."""
