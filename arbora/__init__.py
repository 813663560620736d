"""A PySpark engine for hierarchical text benchmarks and training-data pipelines."""
