"""Storage: versioned tables under a manifest."""
