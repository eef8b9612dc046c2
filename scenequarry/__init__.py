"""A PySpark engine for labelled 3-D point scenes."""
