"""Continuous intake and review as Structured Streaming jobs."""
