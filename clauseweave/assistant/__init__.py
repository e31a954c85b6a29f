"""Bounded tools over the DataFrames and the citation-checked tool loop."""
