"""Structured Streaming forms of the ordered folds and of the telemetry windows."""
