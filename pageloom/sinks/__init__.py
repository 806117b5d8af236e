"""Sinks: CSV, JSON, progress, image manifests, consumer callbacks."""
