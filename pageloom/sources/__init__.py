"""Sources: captured pages, URL lists, records, events, site parameters."""
