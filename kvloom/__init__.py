"""Ordered, versioned key-value analytics as DataFrame plans."""
