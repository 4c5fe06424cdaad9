"""Structured Streaming forms of the telemetry and lifecycle operators."""
