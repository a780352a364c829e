"""Ingestion by Structured Streaming."""
