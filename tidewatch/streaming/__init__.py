"""Structured Streaming form of the monitoring report."""
