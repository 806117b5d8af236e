"""Plan-level helpers and end-to-end plans."""
