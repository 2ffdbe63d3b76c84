"""quillspark: a Spark-first engine for large columns of text."""
