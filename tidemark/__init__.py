"""tidemark: document retrieval and corpus analytics on PySpark."""
