"""A PySpark engine for integrating location records from many sources and querying the result."""
