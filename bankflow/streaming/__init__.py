"""Clickstream pipeline on Structured Streaming."""
