"""Part of the linting engine: functions."""
