"""A PySpark analytics engine: lakehouse tables, checks, serving queries and streams."""
