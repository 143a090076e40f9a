"""Relational, retrieval, graph and quality operators on DataFrames."""
