"""Event-time windows, deduplication and keyed state over Structured Streaming."""
