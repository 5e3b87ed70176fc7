"""Corpus operators for training-data pipelines: deduplication, filtering, mixing and sharding.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; ``tidemark.llm.queries`` wires them to the tables of a dataset folder.
"""
