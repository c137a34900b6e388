"""ragmill: retrieval-augmented-generation data processing as declarative PySpark plans."""
