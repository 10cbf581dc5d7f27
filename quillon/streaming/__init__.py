"""Event-time windows and keyed state, for tables and for streams."""
