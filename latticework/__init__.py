"""A PySpark engine for last-write-wins key-value spaces and vector spaces."""
