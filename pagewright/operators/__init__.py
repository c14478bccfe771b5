"""Part of the linting engine: operators."""
