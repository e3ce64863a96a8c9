"""Notice analytics: streaming."""
