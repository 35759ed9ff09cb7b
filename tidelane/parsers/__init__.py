"""Application messages out of payloads, as column expressions."""
