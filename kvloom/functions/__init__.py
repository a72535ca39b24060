"""Column functions: codecs, orders, capacity arithmetic, membership, error codes."""
