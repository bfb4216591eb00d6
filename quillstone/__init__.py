"""quillstone: Spark-first processing of patent-like text and metadata collections."""
