"""Structured Streaming: run monitor, resumable ingestion, breaker replay."""
