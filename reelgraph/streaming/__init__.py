"""Structured Streaming counterparts of the worker bookkeeping."""
