"""A PySpark engine for annotated text corpora."""
