"""Structured Streaming: ingestion by id, bursts, per-key queues."""
