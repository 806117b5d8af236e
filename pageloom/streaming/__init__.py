"""Structured Streaming operators; each works on a batch DataFrame too, which is its twin."""
