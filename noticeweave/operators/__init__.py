"""Notice analytics: operators."""
