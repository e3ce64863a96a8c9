"""Notice analytics: sources."""
