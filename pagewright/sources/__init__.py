"""Part of the linting engine: sources."""
