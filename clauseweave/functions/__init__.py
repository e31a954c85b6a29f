"""Column-level functions: text, sections, numbers, similarity."""
