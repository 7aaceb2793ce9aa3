"""paperloom: a PySpark engine for document extraction, evaluation and monitoring."""
