"""Error texts that callers may rely on."""

# The texts of errors.
NO_FILES = "No files provided for ingestion"
NO_HANDLER = "No file handler found for MIME type: {}"
HANDLER_NOT_SET = "File handler not set"
OVERLAP = "Overlap must be smaller than chunk size."
NO_QUERY = "Query is required"
NO_EMBEDDINGS = "Failed to generate embeddings"
