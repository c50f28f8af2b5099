"""Invocations as they arrive."""
