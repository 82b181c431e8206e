"""quillwork: text-edit analytics and feature clustering as Spark DataFrame operations."""
