"""Cursors, reactions and watched projections as Structured Streaming queries."""
