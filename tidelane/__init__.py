"""Spark-native analytics over packets, flows and other keyed event-time streams."""
