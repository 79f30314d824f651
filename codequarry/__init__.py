"""PySpark analytics for code-migration programmes and training-data pipelines."""
