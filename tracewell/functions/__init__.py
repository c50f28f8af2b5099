"""Functions of the invocation-log analytics engine."""
