"""Retrieval, knowledge-graph and grounding operators as PySpark DataFrame programs."""
