"""Spark jobs for culling photo collections, and (in llm) for preparing training text."""
