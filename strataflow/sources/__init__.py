"""File scans and sinks, the key/value cache, service connectors."""
