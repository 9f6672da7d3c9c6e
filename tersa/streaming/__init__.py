"""Structured Streaming: sessions that remember what they have seen."""
