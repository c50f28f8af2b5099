"""Spark-first analytics over hosted-LLM invocation logs."""
