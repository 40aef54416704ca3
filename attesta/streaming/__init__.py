"""Structured Streaming jobs; each gives the same table as its batch form."""
