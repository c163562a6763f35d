"""Streaming forms of the operators that keep no unbounded state."""
