"""Structured Streaming: ticks, news, orders."""
