"""Structured Streaming forms of the stateful behaviours."""
