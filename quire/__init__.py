"""quire: document-corpus analytics on Spark."""
