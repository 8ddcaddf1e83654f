"""A PySpark engine for deterministic dataset pipelines."""
