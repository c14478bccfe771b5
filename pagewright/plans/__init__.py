"""Part of the linting engine: plans."""
